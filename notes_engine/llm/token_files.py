"""Token-id files with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by id.  Each task writes its ids in
blocks; a block is one row of a Parquet table in the shared folder, so any store
that Spark writes to will do, and its column ``payload`` is the file format:

    magic "EFT1", then six unsigned 64-bit numbers: documents, ids, bytes of an
    id, null document ids, first document id (two's complement), ids of the task
    before this block; then the concatenated ids; then two Elias-Fano sequences,
    the ends of the documents and the document ids less the first.

An Elias-Fano sequence of n ascending numbers below u keeps floor(log2(u / n))
low bits of each and the rest in unary, 2 bits a number at most.  ``select``
gets number i from the place of the i-th one; counts of ones before every
``STEP``-th byte and the steps of every ``SAMPLE``-th one, in 32 bits, bound the
search.  Readers select the offsets of some documents at once, never of a block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_bounded, stored, tidied, whole_texts
from .tokens import END_ID, RunIds, tokenizer_path

MAGIC, HEAD = b"EFT1", "<4s6Q"
BLOCK_IDS = 1 << 21
SAMPLE, STEP = 512, 64
ENTRIES = 600_000  # of the cache of each task, some 250 MB
READ_DOCS = 4096  # documents of a block whose offsets are selected at once
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """An ascending sequence of non-negative integers, repeats allowed."""

    PACK = "<QQBQQ"

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high = n, universe, low_bits, low, high
        # Ones before each STEP-th byte of the unary part, and the step that holds each SAMPLE-th one: 32 bits each.
        per = np.add.reduceat(_ONES[high], np.arange(0, len(high), STEP), dtype=np.uint32) if len(high) else np.zeros(0, np.uint32)
        self._before = np.concatenate([[0], np.cumsum(per, dtype=np.uint32)]).astype(np.uint32)
        self._sample = (np.searchsorted(self._before, np.arange(0, n, SAMPLE), "right") - 1).astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        rest = (v >> np.uint64(low_bits)).astype(np.int64)
        high = np.zeros(n + (int(rest[-1]) if n else 0) + 1, np.uint8)
        high[rest + np.arange(n)] = 1
        bits = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, universe, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"))

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Number i of the sequence."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_many(np.array([i]))[0])

    def select_many(self, at: np.ndarray) -> np.ndarray:
        """The numbers at ascending places ``at``, by the same structures, at once for all places of a step."""
        out = np.empty(len(at), np.int64)
        step = np.searchsorted(self._before, at, "right") - 1 if len(at) > 1 else np.array([self._step(int(i)) for i in at])
        for k in np.unique(step).tolist():
            mine = np.flatnonzero(step == k) if len(at) < 64 else slice(*np.searchsorted(step, [k, k + 1]))
            ones = np.flatnonzero(np.unpackbits(self.high[k * STEP : (k + 1) * STEP], bitorder="little"))
            out[mine] = k * STEP * 8 + ones[at[mine] - int(self._before[k])] - at[mine]
        return (out << self.low_bits) | self._lows(at)

    def _step(self, i: int) -> int:
        """The step that holds the i-th one, from the sample before it on."""
        k = int(self._sample[i // SAMPLE])
        while int(self._before[k + 1]) <= i:
            k += 1
        return k

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.int64)
        first = at[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[first >> 3] >> (first & 7).astype(np.uint8)) & 1
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def find(self, x: int) -> int:
        """How many numbers are at most x: for ends of documents, the document of id x."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.select(mid) <= x else (lo, mid)
        return lo

    def all(self) -> np.ndarray:
        return self.select_many(np.arange(self.n)) if self.n else np.zeros(0, np.int64)

    def to_bytes(self) -> bytes:
        return struct.pack(self.PACK, self.n, self.universe, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, universe, low_bits, a, b = struct.unpack_from(cls.PACK, data, at)
        at += struct.calcsize(cls.PACK)
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, universe, low_bits, low, high), at + a + b


def write_block(doc_ids: list[int | None], ids: list[bytes], before: int, width: int) -> bytes:
    """A block of documents in ascending order of id, null ids first; ``ids`` as 32-bit integers."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    first = int(known[0]) if len(known) else 0
    gaps = known.view(np.uint64) - np.uint64(first & (2**64 - 1))
    head = struct.pack(HEAD, MAGIC, len(doc_ids), len(flat), width, nulls, first & (2**64 - 1), before)
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in ids]))
    return head + flat.astype(f"<u{width}").tobytes() + ends.to_bytes() + EliasFano.of(gaps).to_bytes()


class Block:
    """A block read back: ``start(i)``, ``ids(i)``, ``doc_of(position)``."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_ids, width, self.nulls, first, self.before = struct.unpack_from(HEAD, data, 0)
        if magic != MAGIC:
            raise ValueError("not a token block")
        self.tokens = np.frombuffer(data, f"<u{width}", self.n_ids, struct.calcsize(HEAD))
        self.ends, at = EliasFano.read(data, struct.calcsize(HEAD) + self.n_ids * width)
        self.gaps, _ = EliasFano.read(data, at)
        self.first = first

    def span(self, a: int, b: int) -> tuple[list, np.ndarray, np.ndarray]:
        """Ids, starts and ends of the documents a to b - 1, by select."""
        ends = self.ends.select_many(np.arange(max(a - 1, 0), b))
        starts = ends[:-1] if a else np.concatenate([[0], ends[:-1]])
        known = np.arange(max(a, self.nulls), b) - self.nulls
        ids = (self.gaps.select_many(known).astype(np.uint64) + np.uint64(self.first)).view(np.int64) if len(known) else np.zeros(0, np.int64)
        return [None] * (b - a - len(known)) + ids.tolist(), starts, ends[1:] if a else ends

    @property
    def doc_ids(self) -> list[int | None]:
        return self.span(0, self.n_docs)[0]

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def ids(self, i: int) -> np.ndarray:
        return self.tokens[self.start(i) : self.ends.select(i)]

    def doc_of(self, position: int) -> int:
        return self.ends.find(position)


def _writer(path: str, end: int, width: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part = RunIds(path, ENTRIES), TaskContext.get().partitionId()
        docs, got, held, before = [], [], 0, 0

        def block() -> pa.RecordBatch:
            cols = pa.array([part]), pa.array([before]), pa.array([held]), pa.array([write_block(docs, got, before, width)], pa.binary())
            return pa.RecordBatch.from_arrays(list(cols), names=["part", "before", "n_ids", "payload"])

        for batch in byte_bounded(batches, "text", 4 << 20):
            for doc_id, x in zip(batch.column(0).to_pylist(), ids.of(batch.column(1).to_pylist(), end), strict=True):
                docs.append(doc_id)
                got.append(x)
                held += len(x) // 4
                if held >= block_ids:
                    yield block()
                    docs, got, before, held = [], [], before + held, 0
        if docs:
            yield block()

    return run


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token files of ``docs`` (doc_id, text, ...) in ascending order of doc_id, as a written table.

    A null or empty text has the end id alone; a null doc_id comes first; rows
    that repeat a doc_id follow each other in the order of their texts.  A long
    text makes a larger block and is never cut.
    """
    path = tokenizer or tokenizer_path()
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
    rows = whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(docs.rdd.getNumPartitions(), 1)
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(tidied(_writer(path, end, width, block_ids)), "part long, before long, n_ids long, payload binary"), "tokens")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the blocks alone.

    The driver holds one number for each task that wrote blocks.
    """
    totals = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(payload.as_buffer().to_pybytes())
                for k in range(0, block.n_docs, READ_DOCS):
                    ids, starts, ends = block.span(k, min(k + READ_DOCS, block.n_docs))
                    wide = block.tokens[starts[0] : ends[-1]].astype("<u4")
                    crc = [zlib.crc32(wide[a:b]) for a, b in zip((starts - starts[0]).tolist(), (ends - starts[0]).tolist(), strict=True)]
                    cols = pa.array(ids, pa.int64()), pa.array(starts + base[part] + block.before), pa.array(ends - starts), pa.array(crc, pa.int64())
                    yield pa.RecordBatch.from_arrays(list(cols), names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
