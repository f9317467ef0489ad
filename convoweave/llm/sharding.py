"""Sharding by histogram sort.

Rows have a key: 64-bit hash of the text, doc_id, place in the staged table; so equal texts are neighbours and no two rows are equal. Shards are contiguous
key ranges of near equal bytes, a row's bytes being those of its text in UTF-8 (0 for null) plus 1. Splitters are
found by exact histograms: all partitions count the rows and bytes below each candidate key; probes between the two
keys that enclose a shard's ideal boundary refine it until the splitter stands at a change of text within
``TOLERANCE`` of a shard's bytes, or, inside a larger group of equal texts, at a row within ``TOLERANCE`` of the boundary.
Then rows are exchanged once. So a group of equal texts stays together unless it alone is larger than the tolerance
and a boundary falls into it; such hot groups are split, between rows that repeat one id and text too, which keeps the shards
near equal.

The counts below every probe are exact, so ranges finer than shards are dealt to tasks and each knows the slot it
starts from: no task sees a whole shard. Rows that repeat an id and a text are interchangeable. A null id sorts first. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.shared import stage

SHARDS = 16
TOLERANCE = 0.01
PROBES_PER_BOUNDARY = 32
RANGES_PER_SHARD = 8
MOST_REFINEMENTS = 8
NO_ID = -(1 << 63)
MOST = (1 << 63) - 1
Key = tuple[int, int, int]
LOWEST: Key = (-(1 << 63), NO_ID, 0)
HIGHEST: Key = (MOST, MOST, MOST)


def keyed(docs: DataFrame) -> DataFrame:
    """The slim rows that are sorted: doc_id, size, text_crc32, h, id, no_id, place; the place is fixed once they are staged."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).cast("bigint").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
        F.col("doc_id").isNull().alias("no_id"),
        F.monotonically_increasing_id().alias("place"),
    )


def below(h: np.ndarray, ids: np.ndarray, places: np.ndarray, probes: list[Key]) -> np.ndarray:
    """For each row the number of (sorted) probes at or below its key."""
    probe = [np.array([p[k] for p in probes], np.int64) for k in (0, 1, 2)]
    keys = [np.r_[x, y] for x, y in zip(probe, (h, ids, places), strict=True)]
    order = np.lexsort((np.r_[np.zeros(len(probes), np.int8), np.ones(len(h), np.int8)], keys[2], keys[1], keys[0]))
    is_probe = order < len(probes)
    out = np.empty(len(h), np.int64)
    out[order[~is_probe] - len(probes)] = np.cumsum(is_probe)[~is_probe]
    return out


def histogram(rows: DataFrame, probes: list[Key]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe: every task counts, only the counts travel."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, size = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            k = below(b["h"].to_numpy(), b["id"].to_numpy(), b["place"].to_numpy(), probes)
            n += np.bincount(k, minlength=len(n))
            np.add.at(size, k, b["size"].to_numpy())
        yield pd.DataFrame({"k": np.arange(len(n)), "n": n, "size": size})

    got = rows.select("h", "id", "place", "size").mapInPandas(count, "k long, n long, size long").groupBy("k").agg(F.sum("n"), F.sum("size")).collect()
    n, size = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for k, a, b in got:
        n[k], size[k] = a, b
    return np.cumsum(size)[:-1], np.cumsum(n)[:-1]


@dataclass(frozen=True)
class Bounds:
    """The least and greatest id and the greatest place that there are, so probes inside a group fall where rows are."""

    least_id: int = NO_ID
    most_id: int = MOST
    most_place: int = MOST


def between(low: Key, high: Key, n: int, bounds: Bounds = Bounds()) -> list[Key]:
    """Up to ``n`` keys above ``low`` and below ``high``, in the first part of the key that leaves room."""
    least, most = (-(1 << 63), bounds.least_id, 0), (MOST, bounds.most_id, bounds.most_place)
    for part in range(3):
        # The part's numbers end below that of ``high`` if all before are equal, else with the greatest there is.
        end = min(high[part], most[part] + 1) if low[:part] == high[:part] else most[part] + 1
        start = max(low[part], least[part] - 1)
        found = sorted({x for k in range(1, n + 1) if start < (x := start + max(1, (end - start) * k // (n + 1))) < min(end, MOST)})
        if found:
            return [(*low[:part], x, *((NO_ID, 0)[part:])) for x in found]
    return []


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> tuple[list[Key], dict[Key, int]]:
    """The ``shards - 1`` splitters, and the number of rows below every key that was probed.

    Stretches between probed keys that hold more than twice a task's share of the rows are probed on, groups of equal texts
    included, so no task of the exchange has much more than the others.
    """
    least, most, place, total, count = rows.agg(F.min(F.when(~F.col("no_id"), F.col("id"))), F.max("id"), F.max("place"), F.sum("size"), F.count("*")).first()
    total, bounds = total or 0, Bounds(NO_ID if least is None else least, MOST if most is None else most, MOST if place is None else place)
    slack = tolerance * total / shards
    goals = [total * k / shards for k in range(1, shards)]
    bytes_below, rows_below = {LOWEST: 0, HIGHEST: total}, {LOWEST: 0}
    found: dict[int, Key] = {}
    while len(found) < len(goals):
        known = sorted(bytes_below)
        at = np.array([bytes_below[k] for k in known])
        wanted: set[Key] = set()
        for g, goal in enumerate(goals):
            if g in found:
                continue
            close = [k for k in known if abs(bytes_below[k] - goal) <= slack]
            at_change = [k for k in close if k[1:] == (NO_ID, 0)]
            i = int(np.searchsorted(at, goal, side="left"))
            if not at_change and i and known[i][0] - known[i - 1][0] <= 1:  # inside a group of equal texts
                at_change = close
            new = between(known[i - 1], known[i], PROBES_PER_BOUNDARY, bounds) if i else []
            if at_change:
                found[g] = min(at_change, key=lambda k: abs(bytes_below[k] - goal))
            elif new:
                wanted.update(new)
            else:
                found[g] = min(known[max(i - 1, 0) : i + 1], key=lambda k: abs(bytes_below[k] - goal))
        if wanted:
            probes = sorted(wanted)
            size, n = histogram(rows, probes)
            bytes_below.update(zip(probes, size.tolist(), strict=True))
            rows_below.update(zip(probes, n.tolist(), strict=True))
    for _ in range(MOST_REFINEMENTS):
        known = [*sorted(rows_below), HIGHEST]
        most_rows = 2 * count / (shards * RANGES_PER_SHARD)
        held = [(a, b, rows_below.get(b, count) - rows_below[a]) for a, b in zip(known, known[1:], strict=False)]
        probes = sorted({x for a, b, n in held if n > most_rows for x in between(a, b, min(PROBES_PER_BOUNDARY, 1 + int(2 * n / most_rows)), bounds)})
        if not probes:
            break
        _, n = histogram(rows, probes)
        rows_below.update(zip(probes, n.tolist(), strict=True))
    return [found[g] for g in range(len(goals))], rows_below


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; slots count from 0 in each shard, in key order."""
    rows = stage(keyed(docs), "shard-keys")  # places are fixed from here on
    cuts, rows_below = splitters(rows, shards, tolerance)
    # Ranges for the exchange: the splitters and, between them, as many probed keys as give tasks of even numbers of rows.
    n = rows.count()
    fine, last = set(cuts), 0
    for key in sorted(rows_below):
        if rows_below[key] - last >= n / (shards * RANGES_PER_SHARD):
            fine.add(key)
            last = rows_below[key]
    edges = sorted(fine - {LOWEST, HIGHEST})
    low_n = [0, *(rows_below[e] if e in rows_below else n for e in edges)]
    shard_of = [sum(c <= e for c in cuts) for e in [LOWEST, *edges]]
    first = [min(low_n[j] for j in range(len(low_n)) if shard_of[j] == s) for s in shard_of]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["range"] = below(b["h"].to_numpy(), b["id"].to_numpy(), b["place"].to_numpy(), edges) if edges else 0
            yield b

    placed = rows.select("size", "text_crc32", "h", "id", "no_id", "place").mapInPandas(
        place, "size long, text_crc32 long, h long, id long, no_id boolean, place long, range long"
    )
    inside = F.row_number().over(Window.partitionBy("range").orderBy("h", "id", "no_id", "place"))
    lookup = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("range").cast("int"))
    return placed.withColumn("_n", inside).select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        "size",
        "text_crc32",
        lookup(shard_of).cast("int").alias("shard"),
        (lookup([a - b for a, b in zip(low_n, first, strict=True)]) + F.col("_n") - 1).cast("bigint").alias("slot"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
