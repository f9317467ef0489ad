"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoweave.shared import discard, stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30))).first()
    return row[0], row[1]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points the neighbours of every vertex at the least of them; a hub is pre-aggregated and its join can be split."""
    if large:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    joined = edges.join(least, edges["a"] == least["v"])
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (columns a, b; any direction, repeats and loops allowed).

    ``root`` is the least vertex of the component. Isolated vertices do not appear. Rounds are written to the
    shared folder; their number grows with the logarithm of the longest path.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stage(ordered, "components")
    state = _state(current)
    while state[0]:
        before_it, current = current, stage(_star(_star(current, True), False), "components")
        discard(before_it)
        state, before = _state(current), state
        if state == before:
            break
    return current.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("v"), F.col("b").alias("root"))
    ).distinct()
