"""Words, lines and shingles of texts in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SPACE


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of the word shingles in order; a shorter text has none."""
    at = F.sequence(F.lit(0), F.size(words) - F.lit(width))
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + F.lit(j)) for j in range(width)]))
    return F.when(F.size(words) >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(words: Column, width: int) -> Column:
    """The shingles themselves, joined by spaces (words hold none)."""
    at = F.sequence(F.lit(0), F.size(words) - F.lit(width))
    joined = F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + F.lit(j)) for j in range(width)]))
    return F.when(F.size(words) >= width, joined).otherwise(F.array().cast("array<string>"))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of a text are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
