"""Quality rules: a learned decision list over statistics of documents.

Statistics are computed by DataFrame functions in one pass over the texts.  A
bounded sample of labelled rows is brought to the driver as numbers, where
sequential covering learns ordered rules: a rule grows condition by condition
by information gain on two thirds of the rows, loses its last conditions where
that helps on the other third, and is kept while it is precise there; the rows
it covers go, and the next rule is learned.  The list is emitted as one ordered
Spark conditional expression.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, others, sampled
from .native_text import count_chars, shingle_hashes, words

SAMPLE = 20_000  # labelled ids, about, that a list is learned from at most
SYMBOLS = "#*$%&|<>"
FEATURES = ["symbol_share", "repeat_share", "dup_line_share", "mean_word", "upper_share", "mark_share", "distinct_share", "digit_share"]
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_stats(docs: DataFrame) -> DataFrame:
    """Statistics and shares beside the other columns of ``docs`` (text, ...), native throughout.

    A null text counts as empty; shares of nothing are 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = docs.withColumn("_w", words(text)).withColumn("_h", shingle_hashes(F.col("_w"), 5))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    t = t.withColumn("_lines", lines)
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    t = t.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda e, at: F.coalesce(F.get(F.col("_s"), at)["x"] == e["x"], F.lit(False))
    t = t.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])))
    step = F.transform("_p", lambda p, j: F.least(F.lit(5), F.coalesce(F.get(F.col("_p"), j + 1) - p, F.lit(5))))
    t = t.withColumn("n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    t = t.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": count_chars(text, SYMBOLS),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_upper": count_chars(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "_marks": count_chars(text, "!?"),
        "_digits": count_chars(text, "0123456789"),
        "_distinct": F.size(F.array_distinct("_w")),
        "_n_lines": F.size("_lines"),
    })
    share = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    t = t.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "_n_lines"), "mean_word": share("word_chars", "n_words"),
        "upper_share": share("_upper", "word_chars"), "mark_share": share("_marks", "word_chars"),
        "distinct_share": share("_distinct", "n_words"), "digit_share": share("_digits", "word_chars"),
    })
    return t.drop("_w", "_h", "_lines", "_s", "_p", "_upper", "_marks", "_digits", "_distinct", "_n_lines")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_most: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] <= self.threshold if self.at_most else x[self.feature] > self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c <= F.lit(self.threshold) if self.at_most else c > F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    got = np.ones(n, bool)
    for c in rule:
        got &= c.holds(x)
    return got


def _grow(x: dict[str, np.ndarray], y: np.ndarray, longest: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(y), bool)
    while len(rule) < longest and (~y & inside).any():
        p, n = (y & inside).sum(), (~y & inside).sum()
        best, gain = None, 1e-9
        for f in x:
            v = x[f][inside]
            order = np.argsort(v, kind="stable")
            vs, ys = v[order], y[inside][order]
            ends = np.flatnonzero(np.diff(vs) > 0)  # a threshold lies after each
            if not len(ends):
                continue
            below_p = np.cumsum(ys)[ends]
            below = ends + 1
            for at_most, pp, tot in ((True, below_p, below), (False, p - below_p, p + n - below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(pp > 0, pp * (np.log2(pp / tot) - np.log2(p / (p + n))), 0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = Condition(f, at_most, float((vs[ends[k]] + vs[ends[k] + 1]) / 2)), g[k]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> tuple[Rule, float, int]:
    worth = []
    for k in range(1, len(rule) + 1):
        got = _covers(rule[:k], x, len(y))
        p, n = int((y & got).sum()), int((~y & got).sum())
        worth.append(((p + 1) / (p + n + 2), p, k))
    precision, p, k = max(worth, key=lambda t: (t[0], -t[2])) if worth else (0.0, 0, 0)
    return rule[:k], precision, p


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 5, longest: int = 4, rules: int = 16) -> list[Rule]:
    """Ordered rules for rows that are ``bad``; none if there are too few of them."""
    n = len(bad)
    grow = np.arange(n) % 3 != 2
    left, out = np.ones(n, bool), []
    while len(out) < rules and (bad & left & grow).sum() >= least:
        part = lambda keep: ({f: v[keep] for f, v in x.items()}, bad[keep])
        rule = _grow(*part(left & grow), longest)
        rule, worth, found = _prune(rule, *part(left & ~grow))
        if not rule or worth < precision and (worth < 0.9 or found < 3 * least) or found == 0:
            break
        out.append(rule)
        left &= ~_covers(rule, x, n)
    return out


def learned_from(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **how) -> list[Rule]:
    """Rules from labelled documents (quality 0 is bad) outside the held-out fold, ``sample`` at most.

    The sample is taken by a threshold on a hash of the id.  Rows that repeat an
    id take its least label, and one of their texts, that of the least hash,
    is learned from.  Rows without a label count for nothing.  Ids are numbers or
    texts, of one type in both tables.
    """
    marked = labels.where("doc_id is not null and quality is not null").where(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    chosen = sampled(marked, F.col("doc_id"), sample, marked.count())
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # its rows are bounded by the sample
    least = F.struct(F.xxhash64("text"), *FEATURES)  # numbers alone are compared and collected
    rows = with_stats(texts).groupBy("doc_id", "_quality").agg(F.min(least).alias("x")).select("doc_id", "_quality", "x.*").collect()
    mixed = lambda i: i * 2654435761 & 0xFFFFFFFF if isinstance(i, int) else zlib.crc32(str(i).encode())
    rows.sort(key=lambda r: (mixed(r.doc_id), r.doc_id))
    x = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return learn(x, np.array([r._quality == 0 for r in rows], bool), **how)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, 0 if none does, as one ordered conditional."""
    out = None
    for k, rule in enumerate(rules, 1):
        cond = rule[0].column()
        for c in rule[1:]:
            cond = cond & c.column()
        out = F.when(cond, k) if out is None else out.when(cond, k)
    return F.lit(0) if out is None else out.otherwise(0)


VERDICT = ["base_failed", "rule", "kept"]


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with ``STATS``, base_failed, rule and kept; columns of ``docs`` with these names are replaced."""
    rest = others(docs, *STATS, *VERDICT)
    held = docs.select(F.struct(*rest).alias("_doc"), F.col("text").cast("string").alias("text"))
    t = with_stats(held)
    t = t.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    # A filter on kept must stay above: pushed below, it would compute arrays again for each of their elements.
    here = F.spark_partition_id() >= 0
    t = t.withColumn("rule", verdict(rules)).withColumn("kept", here & ~F.col("base_failed") & (F.col("rule") == 0))
    return t.select("_doc.*", *STATS, *VERDICT)
