"""MinHash fingerprints of documents and of edited texts, and classes of near-duplicates by bands.

1. A fingerprint has ``COORDS`` coordinates: the least value that a universal
   hash, a multiplication and an addition on 32 bits, which permute them, gives to
   a text's word shingles, cut to 16 bits.  The share of equal coordinates of two
   fingerprints, their likeness, estimates the Jaccard similarity of the sets.
2. ``edited`` compares each document with the next one by id and with a text that
   is cut from both.  Where the rows lie in runs of rising ids, as tables written
   in order do, neighbours are met in the scan and nothing is shuffled; any other
   table is dealt out by range first.  Only the first and last text of each run
   meet in a join.
3. ``BANDS`` bands of ``ROWS`` coordinates are posted, and documents that share a band
   are candidates; fingerprints thin them out and full sets verify them.  At a
   similarity of 0.8 two documents share no band with a probability below 0.0001.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, byte_bounded, release, stored, tidied, whole_texts, words_of
from .minhash_dedup import _digests, class_names, linked, named, shingle_set

COORDS, BANDS, ROWS = 128, 18, 4
SHINGLE, PERCENT = 5, 80
SHARE = 0.67  # of the coordinates of candidates that must agree: fails at 0.8 with a probability below 0.001
RUNS = 64  # of rising ids in one task, beyond which a table counts as unordered
EMPTY = 0xFFFF  # every coordinate of a text without words


def _permutations(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20250117)
    full = np.iinfo(np.uint32).max
    return rng.integers(0, full, coords, np.uint32) | np.uint32(1), rng.integers(0, full, coords, np.uint32)


class Signer:
    """Fingerprints of texts; keeps the hashes of words met lately."""

    def __init__(self, coords: int = COORDS, width: int = SHINGLE):
        self.width, self.hashes = width, WordHashes()
        self.mul, self.add = _permutations(coords)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes of the shingle sets, names of the sets, fingerprints (one a row)."""
        sets = [shingle_set(words_of(t), self.hashes, self.width) for t in texts]
        sizes = np.array([len(s) for s in sets], np.int64)
        prints = np.full((len(sets), len(self.mul)), EMPTY, np.uint16)
        full = np.flatnonzero(sizes)
        if len(full):
            flat = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
            at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            for j, (a, b) in enumerate(zip(self.mul, self.add, strict=True)):
                least = np.minimum.reduceat(flat * a + b, at)
                prints[full, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
        return sizes, class_names(sizes, *_digests(sets, sizes)), prints


def likeness(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> float:
    """Share of equal coordinates; texts without words are like each other and unlike all others."""
    if not na or not nb:
        return float(na == nb)
    return float((a == b).mean())


def edited_text(text: str, following: str) -> str:
    """``text``, the last half of whose characters give way to the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "doc_id long, head long, key long, n_chars long, n long, rep long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
PLACED = f"{FIELDS}, unit long, first boolean, last boolean, text string"


def _told(doc_id: int | None, key: int, text: str, n, rep, own, edit: tuple | None) -> tuple:
    """A row of FIELDS; ``edit``: text, size and fingerprint of the edited text, size and fingerprint of the next."""
    out = doc_id, key if doc_id is None else doc_id, key, len(text), int(n), int(rep)
    if edit is None:
        return *out, None, own.tobytes(), None, None, None
    changed, ne, fe, nn, fn = edit
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return *out, digest, own.tobytes(), fe.tobytes(), likeness(own, n, fe, ne), likeness(own, n, fn, nn)


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def neighbours(coords: int, width: int, by_id: bool):
    """mapInArrow function: ordered (doc_id, text, key) to PLACED.

    The last row of each run has no edited text yet; first and last rows carry
    their texts.  ``by_id``: a run ends where the ids do not rise; else the rows
    of the task are one run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, unit = Signer(coords, width), TaskContext.get().partitionId() << 32
        held, first = None, True  # the row before, and whether its run starts with it
        for batch in byte_bounded(batches, "text", 4 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts, *signer.of(texts), strict=True))
            pairs = [(a, b) for a, b in zip([held, *rows[:-1]], rows, strict=True) if a is not None]
            met = [not by_id or a[0] is not None and b[0] is not None and a[0] < b[0] for a, b in pairs]
            changed = [edited_text(a[2], b[2]) if m else None for (a, b), m in zip(pairs, met, strict=True)]
            sizes, _, prints = signer.of(changed)
            out = []
            for (a, b), m, edit, ne, fe in zip(pairs, met, changed, sizes, prints, strict=True):
                doc_id, key, text, n, rep, own = a
                row = _told(doc_id, key, text, n, rep, own, (edit, ne, fe, b[3], b[5]) if m else None)
                out.append((*row, unit, first, not m, text if first or not m else None))
                unit, first = unit + (not m), not m
            held = rows[-1]
            yield _batch(out, PLACED)
        if held is not None:
            doc_id, key, text, n, rep, own = held
            yield _batch([(*_told(doc_id, key, text, n, rep, own, None), unit, first, True, text)], PLACED)

    return run


def _run_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last id of each run of rising ids; a row of nulls for a null id or too many runs."""
    runs, last, bad = [], None, False
    for batch in batches:
        bad = bad or batch.column(0).null_count > 0 or len(runs) > RUNS
        if bad or not batch.num_rows:
            continue
        ids = np.asarray(batch.column(0), np.int64)
        breaks = np.flatnonzero(ids[1:] <= ids[:-1]) + 1
        starts, ends = [0, *breaks], [*breaks, len(ids)]
        if last is not None and ids[0] > last:  # the last run goes on
            runs[-1][1] = int(ids[ends.pop(0) - 1])
            del starts[0]
        runs += [[int(ids[s]), int(ids[e - 1])] for s, e in zip(starts, ends, strict=True)][: RUNS + 1]
        last = int(ids[-1])
    bad = bad or len(runs) > RUNS
    yield _batch([(None, None)] if bad else [tuple(r) for r in runs], "low long, high long")


def _apart(runs: DataFrame) -> bool:
    """Whether runs (low, high), a few of each task, have no nulls and do not overlap."""
    following = F.lead("low").over(Window.orderBy("low", "high"))
    return runs.withColumn("after", following).where("low is null or high is null or after <= high").isEmpty()


def _joined(placed: DataFrame, coords: int, width: int) -> DataFrame:
    """FIELDS of all rows: last rows of runs meet the first row of the next run, and the last run the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(coords, width)
        for batch in byte_bounded(batches, "text", 4 << 20):
            rows = batch.to_pylist()
            changed = [edited_text(r["text"], r["then_text"]) for r in rows]
            sizes, _, prints = signer.of(changed)
            of = lambda b: np.frombuffer(b, np.uint16)
            out = [
                _told(r["doc_id"], r["key"], r["text"], r["n"], r["rep"], of(r["fingerprint"]), (c, ne, fe, r["then_n"], of(r["then_fingerprint"])))
                for r, c, ne, fe in zip(rows, changed, sizes, prints, strict=True)
            ]
            yield _batch(out, FIELDS)

    names = [f.split()[0] for f in FIELDS.split(", ")]
    units = placed.where("first").select("unit", "doc_id", "key")
    order = Window.orderBy(F.asc_nulls_last("doc_id"), "key", "unit")  # one row for each run: numbers alone
    start = F.first("unit").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turns = units.select("unit", F.coalesce(F.lead("unit").over(order), start).alias("then"))
    firsts = placed.where("first").select(F.col("unit").alias("then"), F.col("text").alias("then_text"), F.col("n").alias("then_n"), F.col("fingerprint").alias("then_fingerprint"))
    ends = placed.where("last").join(turns, "unit").join(firsts, "then").select("text", "doc_id", "key", "n", "rep", "fingerprint", "then_text", "then_n", "then_fingerprint")
    return placed.where("not last").select(*names).unionByName(ends.mapInArrow(tidied(run), FIELDS))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def edited(docs: DataFrame, coords: int = COORDS, width: int = SHINGLE) -> DataFrame:
    """FIELDS for every row of ``docs``: its fingerprint and that of its edited text, by ascending doc_id.

    A null text is empty.  Rows of one doc_id follow each other by a hash of
    their texts, null ids come last, and the first row follows the last; a
    single row follows itself.  The answer rests on a stored table
    (``rests_on``).
    """
    rows = _rows(docs)
    in_order = _apart(rows.select("doc_id").mapInArrow(_run_ends, "low long, high long"))
    if in_order:
        placed = stored(rows.mapInArrow(tidied(neighbours(coords, width, True)), PLACED), "prints")
        ends = placed.where("first or last").groupBy("unit").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        in_order = _apart(ends.select("low", "high"))  # of the rows as they came this time
        if not in_order:
            release(placed)
    if not in_order:
        order = [F.asc_nulls_last("doc_id"), F.asc("key")]
        placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(neighbours(coords, width, False)), PLACED), "prints")
    out = _joined(placed, coords, width)
    out.rests_on = (placed,)
    return out


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, fingerprints, as lists of coordinates."""
    for batch in batches:
        prints = batch.column(batch.num_columns - 1)
        flat = np.frombuffer(b"".join(prints.to_pylist()), np.uint16).view(np.int16)
        each = len(flat) // max(1, batch.num_rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * each), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=["rep", "head", "doc_id", "n", "sig"])


def bands(fingerprint: Column, count: int = BANDS, rows: int = ROWS) -> Column:
    """Hashes of the bands of a fingerprint (two bytes a coordinate), each with its number."""
    return F.array(*[F.xxhash64(F.lit(b), F.substring(fingerprint, 2 * rows * b + 1, 2 * rows)) for b in range(count)])


def with_classes(prints: DataFrame, docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, coords: int = COORDS, share: float = SHARE, count: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``prints`` (FIELDS, of ``docs``) with class_id, the smallest doc_id that links of near-duplicates reach.

    Two documents are linked if they share a band and ``100 * intersection >=
    percent * union`` holds for their shingle sets.  Texts without words are
    alone.  Equal sets are one row of the join; a band that many share is
    linked to leaders first, then in blocks, so no link between different classes is
    lost.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "head", "doc_id"))
    classes = prints.where("n > 0").groupBy("rep").agg(first.alias("first"), F.first("n").alias("n"), F.first("fingerprint").alias("fingerprint"))
    classes = stored(classes.select("rep", "first.head", "first.doc_id", "n", "fingerprint"), "classes")
    posted = classes.select("rep", F.explode(bands(F.col("fingerprint"), count, rows)).alias("pair"))
    shared = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("lists")).where("lists > 1").select("pair")
    lists = stored(posted.join(shared, "pair").select("rep", "pair"), "lists")
    by_rep = classes.select("rep", "head", "doc_id", "n", "fingerprint").mapInArrow(_expanded, "rep long, head long, doc_id long, n long, sig array<short>").withColumn("more", F.array().cast("array<short>"))
    texts = _rows(docs).select(F.coalesce("doc_id", "key").alias("head"), "text")
    found = linked(lists, by_rep, texts, width, percent, (coords, int(share * coords), 0, share))
    release(lists)
    out = named(prints, classes, found).withColumnRenamed("component_id", "class_id").drop("kept")
    out.rests_on = (*getattr(prints, "rests_on", ()), classes, found)
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id for every row.

    Fingerprints are in hexadecimal digits.  Repeated rows are given as often as
    they occur, extra columns are ignored, an empty table gives an empty table;
    ``edited`` and ``with_classes`` say the rest.
    """
    out = with_classes(edited(docs), docs)
    show = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", "n_chars", "edited_sha256", show("fingerprint"), show("edited_fingerprint"), "near_edited", "near_next", "class_id")
