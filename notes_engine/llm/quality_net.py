"""Quality of a text by random indexing and a small network.

Every word has a number, made from its hash, and with it a sparse random index
vector.  A word's context vector sums the index vectors of its neighbours in all
training texts; the word vector is both together.  Word vectors and the vectors
of word shapes are each pooled over the whole text, and a network of two layers
gives a probability, calibrated by a temperature that is fitted on rows the
network has not seen.

Context vectors are whole numbers, summed by the tasks and then by blocks of
words, so they do not depend on how the texts are dealt.  ``WORDS`` numbers are
shared by all words: no word is left out, and words of one number share their
vectors.  Texts never reach the driver, only these sums and the pooled vectors of
the labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_bounded, sampled, tidied, whole_texts

SAMPLE = 6_000  # labelled ids, about, that the network learns from at most
DIM, NONZERO, REACH, HIDDEN = 64, 6, 2, 32
WORDS, SHAPES = 1 << 17, 1 << 16  # numbers of words and of shapes
SHORT = sum(6**k for k in range(7))  # shapes of up to six classes, each with a number of its own; longer ones share the rest
BLOCKS = 256  # of words, in which contexts are summed
_CLASSES = re.compile(rb"([A-Z]+)|([a-z\x80-\xff]+)|([0-9]+)|([!?]+)|([#*$%&|<>]+)|(.)", re.S)


def shape(run: bytes) -> int:
    """Number of the classes of characters of a whole word in order, each run of a class once."""
    classes = [m.lastindex for m in _CLASSES.finditer(run)]
    if len(classes) > 6:
        return SHORT + xxhash.xxh64_intdigest(bytes(classes), 13) % (SHAPES - SHORT)
    at = 0
    for c in classes:
        at = 6 * at + c
    return at


def index_places(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of ``n`` index vectors."""
    rng = np.random.default_rng(seed)
    return np.argpartition(rng.random((n, DIM), np.float32), NONZERO, axis=1)[:, :NONZERO], rng.choice(np.array([-1, 1], np.int32), (n, NONZERO))


def index_vectors(n: int, seed: int) -> np.ndarray:
    places, signs = index_places(n, seed)
    out = np.zeros((n, DIM), np.float32)
    np.put_along_axis(out, places, signs / np.float32(np.sqrt(NONZERO)), axis=1)
    return out


class Tokens(dict):
    """Number of the word and number of the shape of each run of characters."""

    def __missing__(self, run: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[run] = got = xxhash.xxh64_intdigest(run.lower(), 11) % WORDS << 16 | shape(run)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def runs(text: str | None) -> list[bytes]:
    """Words of a text; a word that repeats the one before it, or stands in a repeated line, adds a mark of that."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.split()
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in data.split(b"\n") if x.strip()]
    if len(lines) > 1:
        seen: set[bytes] = set()
        for x in lines:
            if x in seen:
                again += len(x.split())
            seen.add(x)
    return words + [b"\1again"] * again


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task, as a block number and compressed 32-bit integers, four byte planes."""
    tokens, (places, signs) = Tokens(), index_places(WORDS, 1)
    sums = np.zeros(WORDS * DIM, np.int32)
    for batch in byte_bounded(batches, "text", 4 << 20):
        docs = [tokens.of(runs(t)) >> 16 for t in batch.column(0).to_pylist()]
        at, doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        for k in range(1, REACH + 1):
            near = np.flatnonzero(doc[k:] == doc[:-k])
            for x, y in ((at[near], at[near + k]), (at[near + k], at[near])):
                for j in range(NONZERO):
                    np.add.at(sums, x * DIM + places[y, j], signs[y, j])
    for i, block in enumerate(sums.reshape(BLOCKS, -1)):
        if block.any():
            planes = np.ascontiguousarray(block.view(np.uint8).reshape(-1, 4).T)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(planes, 1)], pa.binary())], names=["block", "data"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Context vectors of length 1 of each block, from the sums of all tasks."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
            got = np.ascontiguousarray(planes.T).view("<i4").ravel()
            sums[i] = sums.get(i, 0) + got.astype(np.int64)
    for i, x in sums.items():
        x = x.reshape(-1, DIM)
        x = (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "data"])


def contexts(docs: DataFrame) -> np.ndarray:
    """Context vectors of all words of all texts of ``docs`` (text, ...): one table of fixed size."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    rows = texts.mapInArrow(tidied(_contexts), "block int, data binary").repartition("block").mapInArrow(_summed, "block int, data binary").collect()
    out = np.zeros((BLOCKS, WORDS // BLOCKS, DIM), np.float32)
    for r in rows:
        out[r.block] = np.frombuffer(r.data, "<f4").reshape(-1, DIM)
    return out.reshape(WORDS, DIM)


class Vectors:
    """Word and shape vectors, which pool a text."""

    def __init__(self, context: np.ndarray):
        self.word_table, self.shape_table = index_vectors(WORDS, 1) + context, index_vectors(SHAPES, 2)

    def pool(self, words: list[bytes], tokens: Tokens) -> np.ndarray:
        out = np.zeros(2 * DIM, np.float32)
        if words:
            rows, n = np.unique(tokens.of(words), return_counts=True)
            n = n.astype(np.float32) / len(words)
            out[:DIM], out[DIM:] = n @ self.word_table[rows >> 16], n @ self.shape_table[rows & 0xFFFF]
        return out


class QualityNet:
    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        self.temperature = 1.0
        self._fit(x, y, np.random.default_rng(seed))

    def _fit(self, x: np.ndarray, y: np.ndarray, rng, epochs: int = 60, rate: float = 0.005) -> None:
        self.mean, self.std = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(2 * DIM), np.ones(2 * DIM))
        p = {"a": rng.normal(0, 1 / np.sqrt(2 * DIM), (2 * DIM, HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
        self.p = p
        if not len(x) or len(set(y.tolist())) < 2:
            p["c"][:] = 0
            p["d"][:] = 0 if not len(x) else np.log((y.mean() + 0.01) / (1.01 - y.mean()))
            return
        z, order = (x - self.mean) / self.std, rng.permutation(len(x))
        held, train = order[: len(x) // 5], order[len(x) // 5 :]
        m, s, step = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
                h = np.tanh(z[at] @ p["a"] + p["b"])
                d = (1 / (1 + np.exp(-(h @ p["c"] + p["d"]))) - y[at]) / len(at)
                dh = d[:, None] * p["c"] * (1 - h * h)
                g = {"a": z[at].T @ dh + 1e-4 * p["a"], "b": dh.sum(0), "c": h.T @ d + 1e-4 * p["c"], "d": d.sum(keepdims=True)}
                step += 1
                for k, v in g.items():
                    m[k], s[k] = 0.9 * m[k] + 0.1 * v, 0.999 * s[k] + 0.001 * v * v
                    p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        logits, target = self._logits(x[held]), y[held]
        grid = np.geomspace(0.5, 8, 41)
        loss = [np.logaddexp(0, np.where(target == 1, -1, 1) * logits / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.std @ self.p["a"] + self.p["b"]) @ self.p["c"] + self.p["d"][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -60, 60)))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityNet:
    """A network learned from the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks.

    Word vectors come from all rows of ``docs``.  The network learns from
    ``sample`` ids, about, by a threshold on a hash of the id, each pooled over its whole text.
    Rows that repeat an id take its least label and one of their texts, that of the least vector.
    """
    vectors = Vectors(contexts(whole_texts(docs)))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, tokens = shared.value, Tokens()
        for batch in byte_bounded(batches, "text", 4 << 20):
            x = [vectors.pool(runs(t), tokens).astype("<f4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["doc_id", "y", "x"])

    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_y"))
    chosen = sampled(marked, F.col("doc_id"), sample, marked.count())
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # its rows are bounded by the sample
    pooled = texts.select(F.col("doc_id").cast("long"), F.col("_y").cast("double"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, y double, x binary")
    rows = pooled.groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    x = np.stack([np.frombuffer(r.x, "<f4") for r in rows]) if rows else np.zeros((0, 2 * DIM), np.float32)
    net = QualityNet(x, np.array([r.y for r in rows], float))
    net.vectors = shared
    return net


def scored(docs: DataFrame, net: QualityNet) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text, ...); a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, tokens = net.vectors.value, Tokens()
        for batch in byte_bounded(batches, "text", 4 << 20):
            x = np.stack([vectors.pool(runs(t), tokens) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.scores(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, score double")
