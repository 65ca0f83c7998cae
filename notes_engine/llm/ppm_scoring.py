"""Log probability of texts under a byte trie of the training texts (PPM) and under a word count model.

A text is its words, lower-case A-Z, each followed by a space, and an end mark.
The first ``HEAD`` symbols of a word are coded with the last bytes of the word
before it as context; later symbols with the word's own bytes, back to its start.
So each coded symbol is one of two kinds of unit that repeat: a junction (end of
a word, start of the next) or a symbol inside a word.

1. Each task codes its texts in chunks: a dictionary of words, the texts as
   codes, and the distinct grams (context and symbol) with training counts.
   Words and grams are dealt to buckets by hash, grams by their last two context
   bytes, and kept as sorted, compressed arrays, one for each chunk and bucket.
2. For each bucket, counts are summed over all chunks.  A first pass gives the
   escape table and the counts of orders 1 and 0, both of fixed size; the second
   codes the grams by ``ppm_core``.
3. Counts and scores return to their chunks in the order they came in, and each
   chunk scores its texts.  Nothing that grows with the corpus is broadcast or
   brought to the driver.  There are as many buckets as input tasks, times two,
   so a bucket does not grow with the corpus until ``MOST_BUCKETS``.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_bounded, give_back, stored, tidied, whole_texts, words_of
from .ppm_core import D_BINS, N_BINS, LowOrders, code_shard, escape_cases, escape_table

ORDER, HEAD, TAIL = 6, 3, 3
CHUNK_TOKENS = 1_000_000
LEAST_BUCKETS, MOST_BUCKETS = 24, 8192
DOCS, GRAMS, WORDS = 0, 1, 2  # kinds of rows
_SPACE, _END = 32, 10
_U = np.uint64


Blob = tuple[np.ndarray, np.ndarray, np.ndarray]


def _blob(joined: bytes) -> Blob:
    """Words, joined by spaces, in one buffer with a space before and after each; the start of each, and its length with spaces."""
    if not joined:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == _SPACE)
    sizes = np.diff(np.concatenate([[-1], gaps, [len(joined)]])) + 1
    x = np.frombuffer(b" " + joined.replace(b" ", b"  ") + b" ", np.uint8)
    return x, np.cumsum(sizes) - sizes, sizes


_KEPT = np.array([(1 << (8 * (k + 1))) - 1 for k in range(ORDER + 1)], _U)  # a symbol and k bytes before it


def _inner(blob: Blob) -> tuple[np.ndarray, np.ndarray]:
    x, starts, sizes = blob
    word = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(x)) - starts[word]
    wide = x.astype(_U)
    key = wide.copy()
    for j in range(1, min(ORDER + 1, len(x))):
        key[j:] |= wide[:-j] << _U(8 * j)
    at = np.flatnonzero(pos > HEAD)
    length = np.minimum(pos[at], ORDER)
    return (key[at] & _KEPT[length]) | (length.astype(_U) << _U(56)), word[at]


def inner_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the symbols after the first ``HEAD`` of each word, and the word each belongs to."""
    return _inner(_blob(b" ".join(words)))


def word_ends(blob: Blob) -> tuple[np.ndarray, np.ndarray]:
    """Packed first symbols (with their number) and last bytes (with their number) of each word."""
    x, starts, sizes = blob
    first, last = np.minimum(sizes - 1, HEAD), np.minimum(sizes - 2, TAIL)
    heads, tails = first.astype(_U) << _U(24), last.astype(_U) << _U(24)
    for k in range(HEAD):
        at = np.flatnonzero(first > k)
        heads[at] |= x[starts[at] + 1 + k].astype(_U) << _U(8 * k)
    for k in range(TAIL):
        at = np.flatnonzero(last > k)
        tails[at] |= x[starts[at] + sizes[at] - 2 - k].astype(_U) << _U(8 * k)
    return heads, tails


_END_HEAD = _U(_END | 1 << 24)
_NO_TAIL = _U(0)  # start of a text; words have one byte at least


def junctions(codes: np.ndarray, starts: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Junction of every token of every text, the end mark as the last token of each."""
    n = np.diff(np.concatenate([starts, [len(codes)]]))
    ends = np.cumsum(n + 1) - 1
    word = np.ones(len(codes) + len(n), bool)
    word[ends] = False
    h, t = np.full(len(word), _END_HEAD), np.full(len(word), _NO_TAIL)
    h[word] = heads[codes]
    after = np.roll(word, 1)
    after[0] = False
    t[after] = tails[codes]
    return h | t << _U(32)


def junction_grams(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of distinct junctions, and the junction each belongs to."""
    hn, tn = ((units >> _U(24)) & _U(255)).astype(np.int64), ((units >> _U(56)) & _U(255)).astype(np.int64)
    cols = [((units >> _U(32 + 8 * (TAIL - 1 - k))) & _U(255)) for k in range(TAIL)]
    cols.append(np.where(tn > 0, _U(_SPACE), _U(_END)))
    cols += [((units >> _U(8 * k)) & _U(255)) for k in range(HEAD)]
    keys, owner = [], []
    for s in range(HEAD):
        at = np.flatnonzero(hn > s)
        key, length = cols[TAIL + 1 + s][at].copy(), np.minimum(s + 1 + tn[at], ORDER)
        for j in range(1, ORDER + 1):
            i = TAIL + 1 + s - j
            if i >= 0:
                key |= np.where(length >= j, cols[i][at], _U(0)) << _U(8 * j)
        keys.append(key | length.astype(_U) << _U(56))
        owner.append(at)
    return np.concatenate(keys), np.concatenate(owner)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct values and the place of each value among them; by hashing, since most values repeat."""
    met = pa.array(x).dictionary_encode()
    values = met.dictionary.to_numpy()
    order = np.argsort(values)
    place = np.empty(len(values), np.int64)
    place[order] = np.arange(len(values))
    return values[order], place[met.indices.to_numpy()]


def _pack(numbers: np.ndarray) -> bytes:
    """Integers by byte planes, compressed; ascending ones should come as differences."""
    planes = np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return len(numbers).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes).tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=_U(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=_U)


def _gram_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    shard = (grams >> _U(8)) & _U(0xFFFF)
    return (((shard * _U(0x9E3779B97F4A7C15)) >> _U(40)) % _U(buckets)).astype(np.int64)


def _word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))


_FIELDS = [("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary()), ("counts", pa.binary())]
_SCHEMA = "kind int, chunk long, bucket int, ids array<long>, held array<boolean>, sizes array<int>, data binary, counts binary"
_RETURNED = "kind int, chunk long, bucket int, data binary, total long, kinds long"


def _chunk(number: int, ids: list, held: list[bool], docs: list[np.ndarray], met: list[bytes], buckets: int) -> pa.RecordBatch:
    sizes = np.array([len(d) for d in docs], np.int64)
    raw = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    # Words go by bucket and then by how often they occur, and a text names them by (place in the bucket, bucket), so that frequent words have small codes.
    by = _word_buckets(met, buckets)
    order = np.lexsort((-np.bincount(raw, minlength=len(met)), by))
    words, place = [met[i] for i in order.tolist()], np.empty(len(met), np.int64)
    place[order] = np.arange(len(met))
    edges = np.searchsorted(by[order], np.arange(buckets + 1))
    codes = place[raw]
    train = ~np.array(held, bool)
    counts = np.bincount(codes[np.repeat(train, sizes)], minlength=len(words)).astype(np.int64)
    blob = _blob(b" ".join(words))
    heads, tails = word_ends(blob)
    units, at = _distinct(junctions(codes, np.cumsum(sizes) - sizes, heads, tails))
    unit_counts = np.bincount(at, weights=np.repeat(train, sizes + 1), minlength=len(units))
    (a, wa), (b, ub) = _inner(blob), junction_grams(units)
    grams, at = _distinct(np.concatenate([a, b]))
    gram_counts = np.bincount(at, weights=np.concatenate([counts[wa], unit_counts[ub]]), minlength=len(grams)).astype(np.int64)
    named = (place - edges[by]) * buckets + by
    rows = [(DOCS, number, 0, ids, held, sizes.astype(np.int32), _pack(named[raw]), None)]
    where = _gram_bucket(grams, buckets)
    for k in np.unique(where).tolist():
        rows.append((GRAMS, number, k, None, None, None, _pack_sorted(grams[where == k]), _pack(gram_counts[where == k])))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        i, j = int(edges[k]), int(edges[k + 1])
        rows.append((WORDS, number, k, None, None, None, zlib.compress(b" ".join(words[i:j]), 1), _pack(counts[i:j])))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)], names=[n for n, _ in _FIELDS])


def _numbers() -> defaultdict[bytes, int]:
    """Numbers words in the order they come."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return known


def _encoder(chunk_tokens: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known = _numbers()
        ids, held, docs, tokens = [], [], [], 0
        for batch in byte_bounded(batches, "text", 4 << 20):
            for doc_id, text, out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                ids.append(doc_id)
                held.append(out)
                docs.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                tokens += len(words) + 1
                if tokens >= chunk_tokens:
                    yield _chunk(number, ids, held, docs, list(known), buckets)
                    give_back()
                    number, known, ids, held, docs, tokens = number + 1, _numbers(), [], [], [], 0
        if ids:
            yield _chunk(number, ids, held, docs, list(known), buckets)

    return run


def _merged(rows) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Grams of a bucket over all chunks, their counts, and the place of each chunk's own grams among them."""
    own = [_unpack_sorted(d) for d in rows["data"]]
    grams, at = _distinct(np.concatenate(own))
    n = np.bincount(at, weights=np.concatenate([_unpack(c).astype(np.int64) for c in rows["counts"]]), minlength=len(grams)).astype(np.int64)
    return grams, n, np.split(at, np.cumsum([len(x) for x in own])[:-1])


def _split(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return grams & _U((1 << 56) - 1), (grams >> _U(56)).astype(np.int64)


_CASES = (ORDER + 1) * 2 * N_BINS * D_BINS


def _counter(rows):
    """Escape cases and counts of pairs of a bucket, as rows (at, n) of two flattened tables."""
    import pandas as pd

    grams, n, _ = _merged(rows)
    table = np.concatenate([escape_cases(*_split(grams), n, ORDER).ravel(), np.bincount((grams & _U(0xFFFF)).astype(np.int64), weights=n, minlength=1 << 16)])
    at = np.flatnonzero(table)
    return pd.DataFrame({"at": at, "n": table[at].astype(np.int64)})


def _coder(pairs: np.ndarray, escapes: np.ndarray):
    def run(rows):
        import pandas as pd

        give_back()  # of the bucket before
        grams, n, own = _merged(rows)
        logp = code_shard(*_split(grams), n, LowOrders(pairs), escapes, ORDER).astype("<f4")
        data = [logp[at].tobytes() for at in own]
        return pd.DataFrame({"kind": GRAMS, "chunk": rows["chunk"], "bucket": rows["bucket"], "data": data, "total": 0, "kinds": 0})

    return run


def _words(joined: bytes) -> pa.Array:
    """Words that were joined by spaces."""
    x = np.frombuffer(joined, np.uint8)
    space = x == _SPACE
    gaps = np.flatnonzero(space)
    ends = np.concatenate([[0], gaps - np.arange(len(gaps)), [len(x) - len(gaps)]]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(x[~space])])


def _summer(rows):
    """Counts over all chunks of each chunk's words; the bucket's totals stand in its first row."""
    import pandas as pd

    own = [_words(zlib.decompress(d)) for d in rows["data"]]
    met = pa.chunked_array(own).combine_chunks().dictionary_encode()
    at = met.indices.to_numpy()
    total = np.bincount(at, weights=np.concatenate([_unpack(c).astype(np.int64) for c in rows["counts"]]), minlength=len(met.dictionary)).astype(np.int64)
    data = [_pack(total[x]) for x in np.split(at, np.cumsum([len(x) for x in own])[:-1])]
    sums = np.zeros((2, len(own)), np.int64)
    sums[:, 0] = total.sum(), (total > 0).sum()
    return pd.DataFrame({"kind": WORDS, "chunk": rows["chunk"], "bucket": rows["bucket"], "data": data, "total": sums[0], "kinds": sums[1]})


_OUT = {"doc_id": "Int64", "held_out": bool, "n_tokens": "int64", "n_known": "int64", "base_score": float, "score": float}


def _scorer(n: int, v: int, ends: int, buckets: int):
    def run(chunk, values):
        import pandas as pd

        give_back()  # of the chunk before
        texts = chunk[chunk["kind"] == DOCS]
        if not len(texts):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in _OUT.items()})
        row = texts.iloc[0]
        named, sizes = _unpack(row["data"]).astype(np.int64), np.asarray(row["sizes"], np.int64)
        mine = chunk[chunk["kind"] == WORDS].sort_values("bucket")
        joined = [zlib.decompress(d) for d in mine["data"]]
        before = np.zeros(buckets, np.int64)  # words in the buckets before
        before[mine["bucket"].to_numpy()] = np.cumsum([0, *(d.count(b" ") + 1 for d in joined)])[:-1]
        codes, blob = before[named % buckets] + named // buckets, _blob(b" ".join(joined))
        known = values[values["kind"] == WORDS].sort_values("bucket")["data"]
        count = np.concatenate([np.zeros(0), *map(_unpack, known)])
        (a, wa), (heads, tails) = _inner(blob), word_ends(blob)
        units, at = _distinct(junctions(codes, np.cumsum(sizes) - sizes, heads, tails))
        b, ub = junction_grams(units)
        grams, back = _distinct(np.concatenate([a, b]))  # as they were sent
        logp, where = np.zeros(len(grams)), _gram_bucket(grams, buckets)
        order = np.argsort(where, kind="stable")
        logp[order] = np.concatenate([np.zeros(0, "<f4"), *(np.frombuffer(d, "<f4") for d in values[values["kind"] == GRAMS].sort_values("bucket")["data"])])
        logp = logp[back]
        inner = np.bincount(wa, weights=logp[: len(a)], minlength=len(count))
        unit = np.bincount(ub, weights=logp[len(a) :], minlength=len(units))[at]
        doc, doc_all = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes)), sizes + 1)
        total = lambda w, d=doc: np.bincount(d, weights=w, minlength=len(sizes))
        return pd.DataFrame({
            "doc_id": pd.array([None if x is None or x != x else int(x) for x in row["ids"]], "Int64"), "held_out": list(row["held"]), "n_tokens": sizes + 1,
            "n_known": (total((count > 0)[codes]) + (ends > 0)).astype(np.int64),
            "base_score": total(np.log10((count + 1) / (n + v + 1))[codes]) + np.log10((ends + 1) / (n + v + 1)),
            "score": total(inner[codes]) + total(unit, doc_all),
        })

    return run


def scored(docs: DataFrame, held: Column, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Rows where ``held`` holds are scored and not learned from.  A null, empty or
    blank text is its end mark alone.  Repeated rows count as often as they
    occur.  If nothing is learned, counts are 0 and every byte costs the same.
    Extra columns are ignored.  An empty table gives an empty table.
    """
    rows = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 2 * docs.rdd.getNumPartitions()))
    chunks = stored(rows.mapInArrow(tidied(_encoder(chunk_tokens, buckets)), _SCHEMA), "chunks")

    word_rows, gram_rows = (chunks.where(F.col("kind") == k).select("chunk", "bucket", "data", "counts").groupBy("bucket") for k in (WORDS, GRAMS))
    counts = stored(word_rows.applyInPandas(_summer, _RETURNED), "words")
    tokens, kinds = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ends = chunks.where(F.col("kind") == DOCS).agg(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()[0]
    tokens, kinds, ends = int(tokens + ends), int(kinds + (ends > 0)), int(ends)

    table = np.zeros(_CASES + (1 << 16))
    for r in gram_rows.applyInPandas(_counter, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # two tables of fixed size
        table[r["at"]] = r.n
    pairs = table[_CASES:].reshape(256, 256)
    escapes = escape_table(table[:_CASES].reshape(ORDER + 1, 2, -1), LowOrders(pairs))
    coded = gram_rows.applyInPandas(_coder(pairs, escapes), _RETURNED)

    values = coded.unionByName(counts).select(F.col("chunk").alias("part"), "kind", "bucket", "data")
    texts = chunks.where(F.col("kind") != GRAMS).select("chunk", "kind", "bucket", "ids", "held", "sizes", "data")
    out = texts.groupBy("chunk").cogroup(values.groupBy("part")).applyInPandas(_scorer(tokens, kinds, ends, buckets), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
