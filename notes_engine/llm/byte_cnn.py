"""Language of a text by a byte convolutional network.

Filters of two, three and four bytes over byte embeddings, the maximum of each
over a window, and a softmax; trained in numpy on all windows of a bounded sample
of labelled texts, in whole passes over them, and applied to every window of every
text in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SAMPLED, byte_bounded, others, tidied, whole_texts

SAMPLE = 800  # labelled texts of each language, about, that the network is trained on at most
EPOCHS, LEAST_STEPS = 2, 1_200  # passes over all windows of the sample; small samples take as many more as make so many steps
BATCH = 64  # windows of a step
WINDOW, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
UNKNOWN = "und"


class ByteCNN:
    """Weights: embedding, one matrix for filters of all widths, bias, and the output layer."""

    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes, self.span = classes, max(WIDTHS)
        n = FILTERS * len(WIDTHS)
        self.mask = np.repeat(np.concatenate([np.repeat((np.arange(self.span) < w)[:, None], FILTERS, 1) for w in WIDTHS], 1), EMBED, 0).astype(np.float32)
        scale = np.concatenate([np.full(FILTERS, 1 / np.sqrt(w * EMBED)) for w in WIDTHS])
        self.p = {
            "emb": rng.normal(0, 1, (256, EMBED)), "filt": rng.normal(0, 1, (self.span * EMBED, n)) * scale * self.mask,
            "bias": np.zeros(n), "out": rng.normal(0, 0.1, (n, len(classes))), "out_b": np.zeros(len(classes)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["emb"][0] = 0  # padding

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.p["emb"][np.pad(x, ((0, 0), (0, self.span - 1)))]
        b, length, _ = e.shape
        view = np.lib.stride_tricks.as_strided(e, (b, length - self.span + 1, self.span * EMBED), e.strides)
        return np.ascontiguousarray(view).reshape(-1, self.span * EMBED)

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = self._columns(x)
        maps = (cols @ self.p["filt"]).reshape(len(x), x.shape[1], -1)
        return cols, maps, np.maximum(maps.max(1) + self.p["bias"], 0)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        z = self._pool(x)[2] @ self.p["out"] + self.p["out_b"]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, epochs: int = EPOCHS, rate: float = 0.004, seed: int = 6) -> ByteCNN:
        """Adam over ``epochs`` passes, each over all windows in another order; ``weight`` (all alike without it) counts in the loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.ones(len(x)) if weight is None else weight * (len(x) / weight.sum())
        each = -(-len(x) // BATCH)
        epochs = max(epochs, -(-LEAST_STEPS // each))
        step, steps = 0, epochs * each
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for start in range(0, len(x), BATCH):
                at, step = order[start : start + BATCH], step + 1
                g, slow = self._gradients(x[at], y[at], weight[at]), rate * (1 - 0.9 * step / steps)
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] -= (slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        cols, maps, pooled = self._pool(x)
        z = pooled @ self.p["out"] + self.p["out_b"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d *= (weight / len(y)).astype(np.float32)[:, None]
        dp = (d @ self.p["out"].T) * (pooled > 0)
        top = maps.argmax(1)  # where each filter's maximum lies
        rows = cols[(np.arange(len(x)) * x.shape[1])[:, None] + top]  # window, filter, span * embed
        dcols = dp[:, :, None] * (self.p["filt"] * self.mask).T[None]
        demb = np.zeros_like(self.p["emb"])
        padded = np.pad(x, ((0, 0), (0, self.span - 1)))
        for j in range(self.span):
            seen = padded[np.arange(len(x))[:, None], top + j]
            np.add.at(demb, seen.ravel(), dcols[:, :, j * EMBED : (j + 1) * EMBED].reshape(-1, EMBED))
        demb[0] = 0
        return {"emb": demb, "filt": np.einsum("bf,bfc->cf", dp, rows) * self.mask, "bias": dp.sum(0), "out": pooled.T @ d, "out_b": d.sum(0)}


def windows(data: bytes) -> np.ndarray:
    """All of a text in windows of fixed length; the last is padded with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def trained(docs: DataFrame, sample: int = SAMPLE) -> ByteCNN | None:
    """A network learned from ``docs`` (doc_id, text, lang), from ``sample`` texts of each language, about.

    Every language of the rows is a class, and all rows of a rare one are learned
    from.  Others are sampled by a threshold on a hash of id and text; rows that
    repeat both count once.  All windows of a text are learned from, and a text
    weighs the same whatever its length; so do languages.  The driver holds the
    bytes of the sample and takes time for each of its windows: ``sample``,
    languages and the lengths of texts bound both, not the number of rows.
    None without labels.
    """
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and trim(text) != ''")
    key, chosen = F.xxhash64("doc_id", "text"), F.lit(False)
    place = F.pmod(key, F.lit(SAMPLED))
    sizes = {r.lang: r for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("least")).collect()}
    if not sizes:
        return None
    for lang, r in sorted(sizes.items()):
        chosen = F.when(F.col("lang") == lang, place <= max(r.least, int(SAMPLED * min(1, sample / r.n)))).otherwise(chosen)
    texts = known.where(chosen)
    rows = texts.groupBy("lang", key.alias("key")).agg(F.min("text").alias("text")).collect()  # bounded by the sample
    rows.sort(key=lambda r: (r.lang, r.key))
    classes = sorted(sizes)
    cut = [windows(_bytes(r.text)) for r in rows]
    y = np.array([classes.index(r.lang) for r in rows])
    each = 1 / np.bincount(y, minlength=len(classes))[y]
    count = np.array([len(c) for c in cut])
    return ByteCNN(classes).fit(np.concatenate(cut), np.repeat(y, count), np.repeat(each / count, count))


def with_language(docs: DataFrame, net: ByteCNN | None, named: str = "lang_pred", rated: str = "score") -> DataFrame:
    """``docs`` with the language and its probability in two more columns.

    Every window of the text counts, by the mean of its log probabilities.  A
    null text or one without a letter is ``und`` with score 0, and so is every
    text if nothing could be learned.  Columns of ``docs`` with these two names are replaced.
    """
    from pyspark.sql.types import DoubleType, StringType, StructType

    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 30 kB
    held = whole_texts(docs).withColumn("text", F.col("text").cast("string")).select(F.struct(*others(docs, named, rated, "text"), F.col("text").cast("string").alias("text")).alias("doc"))
    schema = StructType([held.schema["doc"]]).add("lang", StringType()).add("score", DoubleType())
    order = [c for c in docs.columns if c.lower() not in (named.lower(), rated.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in byte_bounded(batches, ("doc", "text"), 1 << 20):
            texts = batch.column(0).field("text").to_pylist()
            readable = [bool(t) and net is not None and any(map(str.isalpha, t)) for t in texts]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at = [i for i, r in enumerate(readable) if r]
            if at:
                cut = [windows(_bytes(texts[i])) for i in at]
                ends = np.cumsum([len(c) for c in cut])
                flat = np.concatenate(cut)
                logp = np.concatenate([net.log_probs(flat[k : k + 128]) for k in range(0, len(flat), 128)])
                mean = np.add.reduceat(logp, np.concatenate([[0], ends[:-1]])) / np.array([len(c) for c in cut])[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for i, row in zip(at, p, strict=True):
                    langs[i], scores[i] = net.classes[int(row.argmax())], float(row.max())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc", "lang", "score"])

    rest = [F.col("doc")[c].alias(c) for c in order]
    return held.mapInArrow(tidied(run), schema).select(*rest, F.col("lang").alias(named), F.col("score").alias(rated))
