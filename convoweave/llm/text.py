"""Column expressions on text that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and \\t\\n\\v\\f\\r; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def row_key() -> Column:
    """64-bit key of a row by id and text, null ids included: rows that share it are copies and get one verdict."""
    return F.xxhash64("doc_id", "text")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, also from inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_hashes(word_array: Column, n: int) -> Column:
    """64-bit hashes of all runs of ``n`` consecutive words, in order; empty if there are fewer words.

    Built by doubling: runs of 1, 2, 4, ... words are hashed from two shorter runs each, so a word costs
    about ``log2(n)`` hash steps and no copy of a slice.
    """

    def pair(a: Column, b: Column, shift: int) -> Column:
        return F.transform(a, lambda x, i: F.xxhash64(x, F.get(b, i + shift)))

    def grow(runs: dict[int, Column], size: int) -> Column:
        if size == n:
            full = F.size(runs[size]) - (n - 1)
            return F.when(full > 0, F.slice(runs[size], F.lit(1), full)).otherwise(F.array().cast("array<bigint>"))
        step = max(k for k in runs if size + k <= n)
        return let(pair(runs[size], runs[step], size), lambda x: grow(runs | {size + step: x}, size + step))

    return let(F.transform(word_array, lambda x: F.xxhash64(x)), lambda ones: grow({1: ones}, 1))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names of helper columns that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while f"_{name}".lower() in taken:
            name = "_" + name
        out.append(f"_{name}")
    return out
