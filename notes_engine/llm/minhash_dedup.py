"""Near-duplicate documents by a signature-coordinate inverted join.

1. Every document's distinct word shingles give a set size, a 128-bit digest of
   the set and a MinHash signature of ``COORDS`` coordinates.  Documents with
   equal sets form one class, named by a hash of the digest (``rep``); the text
   of its smallest id (``head``) is read where the set is needed.  So texts that
   share an id are told apart.
2. A class is posted under each (coordinate, value) pair of its signature.
   Pairs of classes that agree in ``MATCH`` coordinates or more are candidates.
   With the rarest pairs first, two such classes must meet in the first
   COORDS - MATCH + 1 of them (prefix); the remaining lists are never merged:
   the count is finished by comparing the two signatures (skip).
   At a similarity of 0.8 a pair agrees in 32 of 40 coordinates on average and
   in fewer than 22 with a probability of about 0.00003.  ``MORE`` coordinates
   of one byte, which are not posted, sharpen the count: a pair must agree in
   ``SHARE`` of all, which fails at 0.8 with a probability below 0.0001.
3. Candidates are confirmed on the full sets.
4. A list is not expanded into all of its pairs.  Its members are first linked
   to three leaders, a few times over; components of the confirmed links follow.
   Classes that still share a list across components are then compared block by
   block, so no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SIEVE_BITS, WordHashes, byte_bounded, release, stored, tidied, whole_texts, words_of
from .graph import components

COORDS, MATCH = 40, 22
MORE, SHARE = 120, 0.67
TURNS = 2  # of leaders, before what is left is paired
BLOCK = 2000  # classes, of which two blocks are compared in one task
SHINGLE, PERCENT = 4, 80

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a shorter text is one shingle; no words, none."""
    h = hashes.of(words)
    if not len(h):
        return h
    width_here = min(width, len(h))
    acc = np.full(len(h) - width_here + 1, width_here, np.uint64)
    for j in range(width_here):
        acc = (acc * _MIX) + _mixed(h[j : len(h) - width_here + 1 + j])
    return np.unique(_mixed(acc))


def _coordinate_keys(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240613)
    full = np.iinfo(np.uint64).max
    return rng.integers(0, full, coords, np.uint64), rng.integers(0, full, coords, np.uint64) | np.uint64(1)


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column(1).to_pylist()


def class_names(n: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """64-bit names of classes, from size and digest."""
    return _mixed(_mixed(h1.view(np.uint64)) + _mixed(h2.view(np.uint64) ^ _MIX) * np.uint64(3) + n.astype(np.uint64)).view(np.int64)


def _digests(sets: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    full = np.flatnonzero(sizes)
    h1, h2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        h1[full] = np.add.reduceat(_mixed(flat ^ _MIX), at).view(np.int64)
        h2[full] = np.bitwise_xor.reduceat(_mixed(flat + _MIX), at).view(np.int64)
    return h1, h2


def _ids(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(a) for a in arrays], np.int64)
    return sizes, np.concatenate([[0], np.cumsum(sizes)])


def signer(width: int, coords: int, more: int):
    """mapInArrow function: (id, text, head, key) to id, head, key, n, rep, sig, more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (xor, mul) = WordHashes(), _coordinate_keys(coords + more)
        for batch in byte_bounded(batches, "text", 4 << 20):
            sets = [shingle_set(words_of(t), hashes, width) for t in _texts(batch)]
            sizes, _ = _ids(sets)
            full = np.flatnonzero(sizes)
            sig, rest = np.zeros((len(sets), coords), np.int32), np.zeros((len(sets), more), np.int8)
            names = class_names(sizes, *_digests(sets, sizes))
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                half = (flat >> np.uint64(32)).astype(np.uint32)  # the coordinates that are only compared need 32 bits
                for j in range(coords):
                    least = np.minimum.reduceat((flat ^ xor[j]) * mul[j], at)
                    sig[full, j] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for j in range(more):
                    least = np.minimum.reduceat((half ^ np.uint32(xor[coords + j] >> np.uint64(32))) * np.uint32(mul[coords + j] & np.uint64(0xFFFFFFFF)), at)
                    rest[full, j] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).view(np.int8)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (sig, rest)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(sizes), pa.array(names), *lists], names=["doc_id", "head", "key", "n", "rep", "sig", "more"])

    return run


SETS = "head long, rep long, shingles array<long>"


def _sieve(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size of the ids (head: long), for use before a join."""
    at = F.expr(f"pmod(head, {SIEVE_BITS}) + 1")
    rows = ids.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(SIEVE_BITS // 8, np.uint8)
    for r in rows:
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def setter(width: int, sieve: np.ndarray):
    """mapInArrow function: (head, text) to head, rep and the whole shingle set, for heads that pass the sieve, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent = WordHashes(), set()
        for batch in byte_bounded(batches, "text", 4 << 20):
            at = np.asarray(batch.column(0), np.int64) % SIEVE_BITS
            batch = batch.filter(pa.array((sieve[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))
            sets = [shingle_set(words_of(t), hashes, width) for t in _texts(batch)]
            sizes, _ = _ids(sets)
            names = class_names(sizes, *_digests(sets, sizes))
            new = [i for i, x in enumerate(zip(batch.column(0).to_pylist(), names.tolist(), strict=True)) if x not in sent and not sent.add(x)]
            sets = [sets[i] for i in new]
            _, at = _ids(sets)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            cols = [batch.column(0).take(pa.array(new, pa.int64())), pa.array(names[new]), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(cols, names=["head", "rep", "shingles"])

    return run


def _agreeing(a: str, b: str) -> Column:
    """Coordinates in which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _alike(a: str, b: str, coords: int, match: int, more: int, share: float) -> Column:
    """Whether two classes agree in enough coordinates; the posted ones are counted first."""
    posted = _agreeing(f"sig{a}", f"sig{b}")
    return (posted >= match) & (posted + _agreeing(f"more{a}", f"more{b}") >= share * (coords + more))


def _near_size(a: str, b: str, percent: int) -> Column:
    """What the sizes alone allow."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) with heads (headu, headv) whose full sets are similar enough, stored."""
    pairs = stored(pairs.select("u", "v", "headu", "headv").distinct(), "candidates")
    wanted = pairs.select(F.explode(F.array("headu", "headv")).alias("head"))
    sets = stored(texts.mapInArrow(tidied(setter(width, _sieve(wanted))), SETS), "sets")
    left, right = sets.toDF("headu", "u", "su"), sets.toDF("headv", "v", "sv")
    both = F.size(F.array_intersect("su", "sv"))
    linked = pairs.join(left, ["u", "headu"]).join(right, ["v", "headv"]).withColumn("both", both)
    links = stored(linked.where(F.col("both") * 100 >= (F.size("su") + F.size("sv") - F.col("both")) * percent).select("u", "v"), "links")
    release(pairs, sets)
    return links


def _offers(lists: DataFrame, found: DataFrame, turn: int) -> DataFrame:
    """Links to try: for each member of a list, leaders of its lists that are in other components, three at most."""
    placed = lists.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "pair", F.coalesce("component", "rep").alias("component"))
    # Keyed hashes choose the same leaders from most of the lists of a group; the first leader is the smallest id.
    order = lambda c, k: F.col(c) if turn == k == 0 else F.xxhash64(c, F.lit(3 * turn + k))
    leaders = placed.groupBy("pair").agg(
        *[F.min_by(F.struct("rep", "component"), order("rep", k)).alias(f"l{k}") for k in range(3)],
        F.min("component").alias("least"), F.max("component").alias("most"),
    ).where("least != most")
    offered = placed.join(leaders, "pair").select("rep", *[F.when(F.col(f"l{k}.component") != F.col("component"), F.col(f"l{k}.rep")).alias(f"l{k}") for k in range(3)])
    taken = offered.groupBy("rep").agg(*[F.min_by(f"l{k}", F.when(F.col(f"l{k}").isNotNull(), order(f"l{k}", k))).alias(f"l{k}") for k in range(3)])
    pairs = taken.select(F.col("rep").alias("u"), F.explode(F.array("l0", "l1", "l2")).alias("v")).where("v is not null")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _paired(lists: DataFrame, found: DataFrame, by_rep: DataFrame, texts: DataFrame, width: int, percent: int, enough: tuple) -> DataFrame:
    """Confirmed links (u, v) between different components of what still shares a list.

    Classes that are reachable through such lists form a cluster.  A cluster is
    cut in blocks of ``BLOCK`` classes and every two blocks are compared in one
    task, with whole sets; only links that join components come out.
    """
    placed = lists.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = placed.groupBy("pair").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("rep").alias("head")).where("least != most")
    rows = stored(placed.join(apart, "pair").select("rep", "component", "head"), "apart")
    cluster_table = components(rows.select(F.col("rep").alias("u"), F.col("head").alias("v")))
    wanted = stored(rows.select("rep", "component").distinct().join(cluster_table.toDF("rep", "cluster"), "rep").join(by_rep.select("rep", "head"), "rep"), "wanted")
    sets = texts.mapInArrow(tidied(setter(width, _sieve(wanted))), SETS)
    sizes = wanted.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    full = wanted.join(sizes, "cluster").join(by_rep.select("rep", "sig", "more"), "rep").join(sets, ["rep", "head"])
    full = full.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    full = full.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component", "sig", "more", "shingles")
    links = stored(full.groupBy("cluster", "i", "j").applyInPandas(_linker(percent, *enough), "u long, v long"), "links")
    release(rows, cluster_table, wanted)
    return links


def _linker(percent: int, coords: int, match: int, more: int, share: float):
    def run(group):
        import pandas as pd

        group = group.sort_values("rep", kind="stable")
        rep, comp, block = (group[c].to_numpy() for c in ("rep", "component", "block"))
        sig, rest = np.stack(group["sig"].to_numpy()), np.stack(group["more"].to_numpy())
        sets = [np.sort(x) for x in group["shingles"]]
        sizes = np.array([len(x) for x in sets])
        first, alone = block == group["i"].iloc[0], group["i"].iloc[0] == group["j"].iloc[0]
        parent = {int(c): int(c) for c in comp}

        def find(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out = []
        left, right = np.flatnonzero(first), np.arange(len(rep)) if alone else np.flatnonzero(~first)
        for x in left.tolist():
            mine = find(int(comp[x]))
            near = right[(comp[right] != comp[x]) & (100 * np.minimum(sizes[right], sizes[x]) >= percent * np.maximum(sizes[right], sizes[x]))]
            if alone:
                near = near[near > x]
            agree = (sig[near] == sig[x]).sum(1)
            near, agree = near[agree >= match], agree[agree >= match]
            agree = agree + (rest[near] == rest[x]).sum(1)
            likely = near[agree >= share * (coords + more)]
            for y in likely[np.argsort(-agree[agree >= share * (coords + more)], kind="stable")].tolist():
                theirs = find(int(comp[y]))
                if theirs == mine:
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                    out.append((int(rep[x]), int(rep[y])))
                    parent[max(mine, theirs)] = mine = min(mine, theirs)
        return pd.DataFrame({"u": pd.array([u for u, _ in out], "int64"), "v": pd.array([v for _, v in out], "int64")})

    return run


def judged(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, coords: int = COORDS, match: int = MATCH, more: int = MORE, share: float = SHARE) -> DataFrame:
    """doc_id, key, n, rep, component_id, kept for every row of ``docs``: ``near_duplicates`` by row.

    ``key`` is xxhash64 of the text and ``rep`` names the class of its shingle set.
    """
    spark = docs.sparkSession
    text, key = F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))
    rows = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key"))
    head = F.coalesce("doc_id", "key")
    texts = rows.select(head.alias("head"), "text")
    signed = stored(rows.select("doc_id", "text", head.alias("head"), "key").mapInArrow(tidied(signer(width, coords, more)), "doc_id long, head long, key long, n long, rep long, sig array<int>, more array<tinyint>"), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull(), "head", "doc_id"))  # a known id before none
    classes = signed.where("n > 0").groupBy("rep").agg(first.alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("more").alias("more"))
    by_rep = classes = stored(classes.select("rep", "first.head", "first.doc_id", "n", "sig", "more"), "classes")

    # Prefixes: pairs of one class only are the rarest and need no list.
    posted = classes.select("rep", F.posexplode("sig").alias("c", "x")).select("rep", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("x").cast("long")).alias("pair"))
    shared = posted.groupBy("pair").agg(F.count(F.lit(1)).alias("lists")).where("lists > 1")
    met = posted.join(shared, "pair").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("lists", "pair"))).alias("met"))
    met = met.where(F.size("met") >= match).select("rep", F.expr(f"slice(met, 1, size(met) - {match} + 1)").alias("met"))
    prefixes = stored(met.select("rep", "met.pair"), "prefixes")
    lists = prefixes.select("rep", F.explode("pair").alias("pair"))

    found = linked(lists, by_rep, texts, width, percent, (coords, match, more, share))
    release(prefixes)
    out = named(signed, classes, found).select("doc_id", "key", "n", "rep", "component_id", "kept")
    out.rests_on = signed, classes, found  # to be released once the result is written
    return out


def linked(lists: DataFrame, by_rep: DataFrame, texts: DataFrame, width: int, percent: int, enough: tuple) -> DataFrame:
    """(node, component) of the classes that confirmed links join, among those that share a list (rep, pair).

    ``by_rep`` has rep, head, n, sig and more of every class, ``texts`` head and
    text; ``enough`` is (posted coordinates, how many must agree, others, share of all).
    """
    links, found = None, lists.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(TURNS):
        offers = stored(_offers(lists, found, turn), "offers")
        if offers.isEmpty():
            break
        a, b = (by_rep.select("rep", "head", "n", "sig", "more").toDF(x, f"head{x}", f"n{x}", f"sig{x}", f"more{x}") for x in "uv")
        likely = offers.join(a, "u").join(b, "v").where(_near_size("nu", "nv", percent) & _alike("u", "v", *enough))
        new = _confirmed(likely, texts, width, percent)
        release(offers)
        if new.isEmpty():
            break
        links, old = new if links is None else links.unionByName(new), found
        found = components(links)
        release(old)

    new = _paired(lists, found, by_rep, texts, width, percent, enough)
    if not new.isEmpty():
        old, found = found, components(new if links is None else links.unionByName(new))
        release(old)
    return found


def named(signed: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """``signed`` (doc_id, n, rep, ...) with component_id and kept.

    The first class of a component is kept: that of the smallest known id, or else of the smallest name.
    """
    placed = found.toDF("rep", "component").join(classes.select("rep", "doc_id"), "rep")
    firsts = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rep")).alias("first"))
    joined = placed.select("rep", "component").join(firsts, "component").select("rep", F.col("first.doc_id").alias("linked_id"), F.col("first.rep").alias("first_rep"), F.lit(True).alias("linked"))
    own = classes.select("rep", F.col("doc_id").alias("own_id")).join(joined, "rep", "left")
    out = signed.join(own, "rep", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("linked"), F.col("linked_id")).otherwise(F.col("own_id"))
    kept = (F.col("n") == 0) | (F.coalesce(F.col("first_rep") == F.col("rep"), F.lit(True)) & component.eqNullSafe(F.col("doc_id")))
    return out.select(*signed.columns, component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, coords: int = COORDS, match: int = MATCH, more: int = MORE, share: float = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, ...).

    Null, empty and blank texts have no shingles and stay alone.  A component is
    named by the smallest id of its rows and the rows of one text are kept, those
    of that id.  Rows that repeat a doc_id with the same text get the same answer;
    different texts of one id are told apart, so two components may bear one id.
    A null doc_id is larger than any other: such a row is kept only where its
    component has no known id, and then the component is null.  Extra columns are
    ignored.  An empty table gives an empty table.
    """
    return judged(docs, width, percent, coords, match, more, share).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")
