"""Tags in a hierarchy: ancestors, counts rolled up to them, paths of tags, and maps nested by the tree.

A ``tree`` is (node, parent), in any number of rows. A node may have several parents; loops are walked once. Null ends
and edges from a node to itself say nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoweave.functions import rendering as R
from convoweave.operators.pages import MOCS, block, lines, union
from convoweave.shared import stage

DEPTH = 2  # levels of maps that a map lists


def edges(tree: DataFrame) -> DataFrame:
    return tree.where("node <> parent").select("node", "parent").distinct()


def closure(tree: DataFrame) -> DataFrame:
    """(node, ancestor, depth): every node with itself (depth 0) and all above it, by the shortest way.

    A round climbs one level from the pairs that the last round found, so there are as many rounds as levels.
    """
    up = stage(edges(tree), "tree")
    every = up.select("node").unionByName(up.select(F.col("parent").alias("node"))).distinct()
    rounds = [stage(every.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")), "tree-0")]
    while True:
        known = reduce(DataFrame.unionByName, rounds).select("node", "ancestor")
        step = rounds[-1].join(up.select(F.col("node").alias("ancestor"), "parent"), "ancestor").select("node", F.col("parent").alias("ancestor"), F.lit(len(rounds)).alias("depth"))
        found = stage(step.distinct().join(known, ["node", "ancestor"], "left_anti"), f"tree-{len(rounds)}")
        if not found.head(1):
            return reduce(DataFrame.unionByName, rounds)
        rounds.append(found)


def rollup(tags: DataFrame, above: DataFrame) -> DataFrame:
    """(tag, own, total): conversations with the tag itself, and with it or anything below it, each counted once.

    ``tags`` is (conv_id, tag); tags outside the tree count for themselves, nodes without conversations have no row.
    """
    has = tags.select("conv_id", "tag").where("tag IS NOT NULL").distinct()
    reached = has.join(above.where("depth > 0").select(F.col("node").alias("tag"), "ancestor"), "tag").select("conv_id", F.col("ancestor").alias("tag"), F.lit(0).alias("own"))
    each = has.withColumn("own", F.lit(1)).unionByName(reached).groupBy("conv_id", "tag").agg(F.max("own").alias("own"))
    return each.groupBy("tag").agg(F.sum("own").alias("own"), F.count("*").alias("total"))


def paths(tree: DataFrame, prefix: str = "") -> DataFrame:
    """(tag, path): the way from the root, like ``tech/python``; of several parents the least is taken. ``prefix`` goes before it."""
    first = edges(tree).groupBy("node").agg(F.min("parent").alias("parent"))
    way = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("up"), "ancestor")))
    return closure(first).groupBy(F.col("node").alias("tag")).agg(F.concat(F.lit(prefix), F.array_join(F.transform(way, lambda x: x["ancestor"]), "/")).alias("path"))


def map_lines(notes: DataFrame, tags: DataFrame, tree: DataFrame, least: int = 3, depth: int = DEPTH) -> DataFrame:
    """Lines of the maps of tags with at least ``least`` conversations in all: the maps below, ``depth`` levels, and the notes of the tag itself."""
    above, ways = closure(tree), stage(paths(tree), "tree-paths")
    counted = stage(rollup(tags, above).where(F.col("total") >= least).join(ways, "tag"), "tree-counts")
    name = lambda way: F.concat(F.replace(way, F.lit("/"), F.lit(" - ")), F.lit(" Tags"))
    page = F.concat(F.lit(f"{MOCS}/"), R.sanitize_filename(name(F.col("path"))), F.lit(".md"))
    mine = counted.select("tag", page.alias("page"), "path", "own", "total")
    below = counted.select(F.col("tag").alias("node"), F.col("path").alias("way"), F.col("total").alias("n"))
    nested = above.where(F.col("depth").between(1, depth)).join(below, "node").join(mine.select(F.col("tag").alias("ancestor"), "page"), "ancestor")
    own = tags.select("conv_id", "tag").distinct().join(mine.select("tag", "page"), "tag").join(notes.select("conv_id", "title"), "conv_id")
    p = F.col("page")
    child = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- [["), name(F.col("way")), F.lit("]] ("), F.col("n").cast("string"), F.lit(")"))
    return union(
        lines(mine, p, 0, F.concat(F.lit("# #"), "path", F.lit("\n\n"), F.col("total").cast("string"), F.lit(" conversations, "), F.col("own").cast("string"), F.lit(" with the tag itself.\n"))),
        block("## Maps Below", nested, p, 1, child, a=F.col("way")),
        block("## Notes", own, p, 4, F.concat(F.lit("- "), R.wikilink(F.col("title"))), a=F.col("title"), c=F.col("conv_id")),
    )
