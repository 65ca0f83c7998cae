"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

Each task cuts its documents into full windows and a tail, and gathers tails in
groups of ``GROUP`` windows.  In a group every piece starts as a partial
partition of its own; the two partial partitions with the largest spread are
merged, the largest sums of one with the smallest of the other, until one is
left.  Its windows are near-equal.  Where the largest of them exceeds the
capacity, the group is partitioned again over one window more.

A document is cut at multiples of the capacity, its tail into pieces of
``PIECE`` ids, and once where a group is full.  Texts and full groups never leave
their task; memory holds one batch of texts and one group.  The pieces of a task's
last, short group (keys and lengths, no texts) are handed on to a second grouping
over all tasks, with ``SHARE`` groups in each of its tasks, so padding does not
grow with the number of partitions.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_bounded, stored, tidied, whole_texts
from .tokens import END_ID, RunIds, tokenizer_path

CAPACITY, GROUP, PIECE, SLACK = 2048, 192, 512, 48
SHARE = 4  # groups in a task of the second grouping
ENTRIES = 500_000  # of the cache of each task, some 200 MB


def karmarkar_karp(sizes: list[int], k: int) -> list[int]:
    """The part, 0 to k - 1, of each item; parts have near-equal sums.

    Ties are broken by the order of the items, so the answer is determined.
    """
    n = len(sizes)
    if k <= 1 or n <= 1:
        return [0] * n
    joined = list(range(n))  # a bin is named by one of its items
    sums = {i: (np.array([s]), np.array([i])) for i, s in enumerate(sizes)}
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, x), (_, y) = heapq.heappop(heap), heapq.heappop(heap)
        (a, ia), (b, ib) = sums.pop(x), sums.pop(y)
        both = len(a) + len(b) - k  # bins that must be shared
        if both > 0:
            p = len(a)
            end = b[::-1][:both], ib[::-1][:both]
            for kept, gone in zip(ia[p - both :].tolist(), end[1].tolist(), strict=True):
                joined[gone] = kept
            a = a.copy()
            a[p - both :] += end[0]
            b, ib = b[: len(b) - both], ib[: len(ib) - both]
        s, i = np.concatenate([a, b]), np.concatenate([ia, ib])
        order = np.argsort(-s, kind="stable")
        sums[x] = s, i = s[order], i[order]
        heapq.heappush(heap, (-int(s[0] - (s[-1] if len(s) == k else 0)), x))
    part = {int(root): at for at, root in enumerate(next(iter(sums.values()))[1])}

    def find(i: int) -> int:
        while joined[i] != i:
            joined[i] = joined[joined[i]]
            i = joined[i]
        return i

    return [part[find(i)] for i in range(n)]


def fit(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Parts that hold at most ``capacity`` each, and their number."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        part = karmarkar_karp(sizes, k)
        if not sizes or np.bincount(part, weights=sizes, minlength=k).max() <= capacity:
            return part, k
        k += 1


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Packer:
    def __init__(self, first: int, capacity: int, group: int, piece: int, slack: int):
        self.next, self.capacity, self.piece = first, capacity, piece
        self.full = max(capacity, group * capacity - slack)
        self.tails, self.held, self.out = [], 0, []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        cut = lambda at, size: (doc_id, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n)
        at = 0
        while n - at >= self.capacity:
            self.out.append((*cut(at, self.capacity), self.next, 0))
            self.next, at = self.next + 1, at + self.capacity
        while at < n:
            size = min(self.piece, n - at, self.full - self.held)
            self.take(cut(at, size))
            at += size

    def take(self, tail: tuple) -> None:
        self.tails.append(tail)
        self.held += tail[2]
        if self.held >= self.full:
            self.flush()

    def hand_on(self) -> None:
        """The pieces of the short group, with no place yet."""
        self.out += [(*t, None, None) for t in self.tails]
        self.tails, self.held = [], 0

    def flush(self) -> None:
        part, k = fit([t[2] for t in self.tails], self.capacity)
        filled = [0] * k
        for t, p in zip(self.tails, part, strict=True):
            self.out.append((*t, self.next + p, filled[p]))
            filled[p] += t[2]
        self.next, self.tails, self.held = self.next + k * bool(self.tails), [], 0

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group: int = GROUP, piece: int = PIECE, slack: int = SLACK, end: int = END_ID) -> DataFrame:
    """The pieces of all documents (doc_id, text, ...) and their places in sequences.

    A null or empty text has the end id alone.  Repeated rows are packed as
    often as they occur; a null doc_id is passed on.  Extra columns are ignored.
    An empty table gives an empty table.  ``sequence_id`` holds the number of
    the task in its high bits; bit 62 marks tasks of the second grouping.
    """
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, packer = RunIds(path, ENTRIES), _Packer(TaskContext.get().partitionId() << 36, capacity, group, piece, slack)
        for batch in byte_bounded(batches, "text"):
            for doc_id, got in zip(batch.column(0).to_pylist(), ids.of(batch.column(1).to_pylist(), end), strict=True):
                packer.add(doc_id, got)
            yield packer.batch()
        packer.hand_on()
        yield packer.batch()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A piece is whole here: a group ends before the one that would overfill it.
        packer = _Packer(1 << 62 | TaskContext.get().partitionId() << 36, capacity, group, piece, slack)
        for batch in batches:
            for tail in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if packer.held + tail[2] > packer.full:
                    packer.flush()
                packer.take(tail)
            yield packer.batch()
        packer.flush()
        yield packer.batch()

    first = stored(whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCHEMA), "packed")
    short = first.where("sequence_id is null")
    ids = short.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, round(ids / (SHARE * group * capacity)))
    dealt = short.repartition(tasks, F.xxhash64("doc_id", "start", "ids_crc32")).sortWithinPartitions("doc_id", "start", "ids_crc32")
    return first.where("sequence_id is not null").unionByName(dealt.mapInArrow(again, SCHEMA))
