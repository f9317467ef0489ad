"""Graph construction: equi-join forms of the pair rules, edge folding, and graph measures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.shared import discard, stage

#: Ranks of up to so many nodes are broadcast in each round.
BROADCAST_NODES = 2_000_000
# The weights of the pair rules.
TAG_FACTOR, TEMPORAL_FACTOR, TEMPORAL_FLOOR, WINDOW_DAYS, SEMANTIC_MIN = 1.5, 0.5, 0.1, 7, 0.3


def topk(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order (Spark prunes groups before the shuffle)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def overlap_join(terms: DataFrame, min_shared: int, factor: float = 1.0) -> DataFrame:
    """(src, dst, shared, weight) for src < dst sharing at least ``min_shared`` terms of (id, term).

    An inverted-index join: pairs meet on terms, never as a product of all rows. Weight is the shared number over
    the larger set's size, times ``factor``.
    """
    terms = terms.select("id", "term").distinct()
    sizes = terms.groupBy("id").agg(F.count("*").alias("n"))
    a, b = terms.select(F.col("id").alias("src"), "term"), terms.select(F.col("id").alias("dst"), "term")
    pairs = a.join(b, "term").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    return (
        pairs.join(sizes.select(F.col("id").alias("src"), F.col("n").alias("n_a")), "src")
        .join(sizes.select(F.col("id").alias("dst"), F.col("n").alias("n_b")), "dst")
        .select("src", "dst", "shared", F.round(F.lit(factor) * F.col("shared") / F.greatest("n_a", "n_b"), 6).alias("weight"))
    )


def band_join(df: DataFrame, width_days: int = WINDOW_DAYS, by: list[str] | None = None) -> DataFrame:
    """(src, dst, days_apart) for src < dst of (id, ts) no more than ``width_days`` apart, by buckets of that width."""
    by = by or []
    micros = width_days * 86_400_000_000
    rows = df.select("id", *by, F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).withColumn("k", F.floor(F.col("t") / micros))
    a = rows.select(F.col("id").alias("src"), *by, F.col("t").alias("ta"), F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)).alias("k"))
    b = rows.select(F.col("id").alias("dst"), *by, F.col("t").alias("tb"), "k")
    near = a.join(b, ["k", *by]).where((F.col("src") < F.col("dst")) & (F.abs(F.col("ta") - F.col("tb")) <= micros))
    return near.select("src", "dst", *by, (F.abs(F.col("ta") - F.col("tb")) / 86_400_000_000).alias("days_apart"))


def temporal_weight(days: Column) -> Column:
    return F.round(TEMPORAL_FACTOR * F.greatest(F.lit(TEMPORAL_FLOOR), 1 - days / WINDOW_DAYS), 6)


def similarity_join(words: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, weight) of word sets (id, word) with Jaccard similarity of ``threshold`` or more.

    Words are hashed to 64 bits and equal sets joined as one. Prefix filter: words in order of rarity; qualifying pairs meet on
    one of a set's first ``n - ceil(threshold * n) + 1`` words, so frequent words join nothing. What a pair shares of
    both prefixes, and the places of the last of these, bound the overlap from above; only pairs within the bound are verified, by
    exact intersection.
    """
    hashed = words.select("id", F.xxhash64("word").alias("w")).distinct()
    df = hashed.groupBy("w").agg(F.count("*").alias("df"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("df", "w"))), lambda x: x["w"])
    sets = hashed.join(df, "w").groupBy("id").agg(ordered.alias("set"))
    sets = stage(sets.withColumn("n", F.size("set")).withColumn("same", F.xxhash64("set", F.lit(7))), "similar-sets")
    classes = sets.groupBy("same", "n").agg(F.min("id").alias("id"))
    each = sets.select("id", "same", "n").join(classes.withColumnRenamed("id", "one"), ["same", "n"]).select("id", "one")
    one = sets.join(classes.select("id"), "id", "left_semi")
    prefix = one.select("id", "n", F.posexplode(F.slice("set", F.lit(1), (F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1).cast("int"))).alias("at", "w"))
    a, b = (prefix.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("at").alias(f"at_{x}"), "w") for x in ("src", "dst"))
    met = a.join(b, "w").where((F.col("src") < F.col("dst")) & (F.least("n_src", "n_dst") >= threshold * F.greatest("n_src", "n_dst") - 1e-9))
    pairs = met.groupBy("src", "dst", "n_src", "n_dst").agg(F.count("*").alias("c"), F.max("at_src").alias("at_src"), F.max("at_dst").alias("at_dst"))
    most = F.col("c") + F.least(F.col("n_src") - F.col("at_src"), F.col("n_dst") - F.col("at_dst")) - 1
    pairs = pairs.where(most >= threshold / (1 + threshold) * (F.col("n_src") + F.col("n_dst")) - 1e-9).select("src", "dst", "n_src", "n_dst")
    both = pairs.join(one.select(F.col("id").alias("src"), F.col("set").alias("s")), "src").join(one.select(F.col("id").alias("dst"), F.col("set").alias("t")), "dst")
    shared = F.size(F.array_intersect("s", "t"))
    found = both.select("src", "dst", (shared / (F.col("n_src") + F.col("n_dst") - shared)).alias("w")).where(F.col("w") >= threshold).select("src", "dst", F.round("w", 6).alias("weight"))
    links = found.unionByName(classes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")))
    x, y = (each.select(F.col("one").alias(c), F.col("id").alias(f"{c}_id")) for c in ("src", "dst"))
    spread = links.join(x, "src").join(y, "dst").where((F.col("src") != F.col("dst")) | (F.col("src_id") < F.col("dst_id")))
    return spread.select(F.least("src_id", "dst_id").alias("src"), F.greatest("src_id", "dst_id").alias("dst"), "weight")


def edge_log(stages: list[tuple[int, str, DataFrame]]) -> DataFrame:
    """One log of (src, dst, stage, relationship, added, weight); weight is the running sum along the stages."""
    parts = [df.select("src", "dst", F.lit(k).alias("stage"), F.lit(name).alias("relationship"), F.col("weight").alias("added")) for k, name, df in stages]
    running = Window.partitionBy("src", "dst").orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    return reduce(DataFrame.unionByName, parts).withColumn("weight", F.round(F.sum("added").over(running), 6))


def fold_edges(log: DataFrame) -> DataFrame:
    """The simple graph: summed weights and the last relationship of each pair."""
    return log.groupBy("src", "dst").agg(F.round(F.sum("added"), 6).alias("weight"), F.max_by("relationship", "stage").alias("relationship"))


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    swapped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *keep)
    return edges.select("src", "dst", *keep).unionByName(swapped)


def ends_of(edges: DataFrame, a: str, b: str, value: str, one: str, other: str) -> DataFrame:
    """(one, other, value) both ways in one pass over the edges."""
    told = [F.struct(F.col(x).alias(one), F.col(y).alias(other), F.col(value).alias(value)) for x, y in ((a, b), (b, a))]
    return edges.select(F.explode(F.array(*told)).alias("x")).select("x.*")


def spread_of(nodes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts a table with a row for each node, if there are few enough."""
    return F.broadcast if nodes.count() <= BROADCAST_NODES else (lambda df: df)


def log_degree(log: DataFrame) -> DataFrame:
    """Ends of logged edges per node; parallel edges count each time."""
    return both_ways(log).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, alpha: float = 0.85, tolerance: float | None = 1e-6, otherwise: Callable[[], DataFrame] | None = None, links: DataFrame | None = None) -> DataFrame:
    """(id, rank) by weighted power iteration over undirected edges; dangling mass is spread evenly.

    Stops after ``rounds`` or when the change is under ``tolerance`` times the number of nodes (None: never).
    A round reads ``edges`` once, one way as they are, and exchanges sums by node only; ranks are written to the shared folder
    each round. If they have not settled, ``otherwise`` gives the result. ``links`` are more edges, those to the many nodes that
    ``edges`` don't reach: so only ends of ``edges`` need be few enough for their ranks to be broadcast to ``edges``.
    """
    n, done = max(1, nodes.count()), tolerance is None
    parts = [edges] if links is None else [edges, links]
    totals = [both_ways(e, "weight").groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias(f"total_{k}")) for k, e in enumerate(parts)]
    ranks = reduce(lambda df, t: df.join(t, "id", "left"), totals, nodes.select("id"))
    total = F.col("total_0") if links is None else F.coalesce(F.col("total_0") + F.col("total_1"), "total_0", "total_1")
    ranks = stage(ranks.select("id", total.alias("total"), F.col("total_0").isNotNull().alias("met"), F.lit(1.0 / n).alias("rank")), "rank-round")
    few = (n if n <= BROADCAST_NODES else ranks.where("met").count()) <= BROADCAST_NODES
    spread = [F.broadcast if of <= BROADCAST_NODES else (lambda df: df) for of in (0 if few else n, n)]
    for _ in range(rounds):
        told = []
        for k, e in enumerate(parts):
            share = (ranks.where("met") if k == 0 else ranks).select("id", (F.col("rank") / F.col("total")).alias("share"))
            a, b = (spread[k](share.select(F.col("id").alias(c), F.col("share").alias(f"{c}_share"))) for c in ("src", "dst"))
            ends = e.select("src", "dst", "weight").join(a, "src", "left").join(b, "dst", "left")
            got = [F.struct(F.col(to).alias("id"), (F.col("weight") * F.col(f"{of}_share")).alias("got")) for of, to in (("src", "dst"), ("dst", "src"))]
            told.append(ends.select(F.explode(F.array(*got)).alias("x")).groupBy(F.col("x.id").alias("id")).agg(F.sum("x.got").alias("got")))
        sent = told[0] if len(told) == 1 else told[0].unionByName(told[1]).groupBy("id").agg(F.sum("got").alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("total").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        new = (
            ranks.withColumn("one", F.lit(1)).join(sent, "id", "left").join(F.broadcast(lost.withColumn("one", F.lit(1))), "one")
            .select("id", "total", "met", "rank", (F.lit((1 - alpha) / n) + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("new"))
        )
        new, before = stage(new, "rank-round"), ranks
        discard(before)
        ranks = new.select("id", "total", "met", F.col("new").alias("rank"))
        ranks.staged_at = new.staged_at
        if tolerance is not None:
            done = (new.agg(F.sum(F.abs(F.col("new") - F.col("rank")))).first()[0] or 0.0) < n * tolerance
            if done:
                break
    return ranks.select("id", "rank") if done or otherwise is None else otherwise()
