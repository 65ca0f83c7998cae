"""Counts of byte-pair tokens, as a column function.

The table of ranks is read once by each Python worker; pieces of text, split by
the tokenizer's pattern, are merged pair by pair in the order of ranks, and
pieces met before are looked up.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits of the common byte-level vocabularies of some 50,000 tokens (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
KEPT = 200_000  # pieces


class Merges(dict):
    """Token counts of pieces (bytes)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def __missing__(self, piece: bytes) -> int:
        n = self._count(piece)
        if len(self) >= KEPT:
            self.clear()
        self[piece] = n
        return n

    def _count(self, piece: bytes) -> int:
        """Pieces left after merging the pair of least rank, the leftmost of equal ones, as long as there is one."""
        if piece in self.ranks:
            return 1
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            least, at = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
            if least == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts)


@functools.cache
def _loaded(path: str, pattern: str):
    import regex

    return Merges(path), regex.compile(pattern)


def count(text: str | None, path: str, pattern: str = PATTERN) -> int:
    """Tokens of a text; none for null."""
    merges, split = _loaded(path, pattern)
    return sum(merges[p.encode("utf-8", "replace")] for p in split.findall(text)) if text else 0


def counter(path: str, pattern: str = PATTERN) -> Callable[[Column], Column]:
    """A function from a text column to its token counts (long), to be passed as ``tokens`` where ``token_estimate`` is the default.

    ``path``: a file of lines of a token in base 64 and its rank, at the same place on every worker.
    """

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: count(t, path, pattern)).astype("int64")

    return lambda x: tokens(x)
