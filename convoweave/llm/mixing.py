"""Mixing sources to target weights by pivotal dependent rounding.

A document's size is its number of words (0 for null and empty texts). Sources in code point order, the null
source last, weigh ``WEIGHTS`` in turn and share ``SHARE`` of all sizes; a target stops at ``MOST_COPIES`` times its
source's size and the excess is shared again by weight until no target is above. Every document of a source is
wanted ``target / source size`` times. The whole part is taken at once, the fractional parts are rounded together:

* documents are grouped by source and a hash of the id, into groups of bounded size;
* inside a group, larger documents first, the carried document and the next one pass words to each other at random,
  one probability rising as the other falls, until one of them is 0 or 1 (the pivotal method with sizes as costs),
  so both expectations and the sum of words are kept and at most one document stays fractional;
* what stays goes up a tree of groups, ``FAN_IN`` at a time, until each source has one, which is drawn by itself.

So a source's words differ from its target by less than one document, most often a small one, and no document is
taken more than the whole part plus one time. All draws are hashes of the ids, so reruns agree. Rows that repeat an id are told
apart by their ordinal among the rows of that id and size. Documents without words are taken 0 times; a source without
words has a target of 0. Extra columns of the input are ignored by ``mix`` and kept by ``resample``, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.llm.ranks import with_rank
from convoweave.llm.text import WORD, free_names, let
from convoweave.shared import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2.0
FAN_IN = 128
INTEGRAL = 1e-9
UNIT = "struct<row:struct<doc_id:bigint,ordinal:int,source:string,size:bigint>,p:double>"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, n_docs, target. Water-filling: each round fixes the sources above their bound."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n_docs"))
    ranked = with_rank(per_source, [F.asc_nulls_last("source")], "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stage(ranked.withColumn("weight", F.get(cycle, F.pmod("rank", F.lit(len(weights))).cast("int"))), "mix-sources")
    bound = F.lit(most) * F.col("source_size")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, n_capped = 0.0, -1
    while True:  # a round per set of sources that reach their bound; each is one small aggregate
        capped = (F.col("weight") * level >= bound) if n_capped >= 0 else F.lit(False)
        row = ranked.agg(
            F.sum(F.when(capped, bound).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(capped.cast("int")).alias("n"),
        ).first()
        if row["n"] is None or row["n"] == n_capped or not row["open"]:
            break
        n_capped, level = row["n"], (total - row["fixed"]) / row["open"]
    return ranked.select("source", "source_size", "n_docs", F.least(F.col("weight") * level, bound).alias("target"))


def draw(row: Column, salt: int) -> Column:
    """A uniform number from 0 to 1, fixed by the row and the salt."""
    return F.pmod(F.xxhash64(row["doc_id"], row["ordinal"], F.coalesce(row["source"], F.lit("")), row["size"], F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)


def pivot(units: Column, salt: int) -> Column:
    """struct<held, done>: ``units`` rounded in order; ``held`` is what stays fractional or null, ``done`` has p of 0 or 1."""

    def unit(x, p):
        p = F.when(p < INTEGRAL, 0.0).when(p > 1 - INTEGRAL, 1.0).otherwise(p)
        return F.struct(x["row"].alias("row"), p.alias("p")).cast(UNIT)

    def pair(a, b):
        words_a, words_b = a["row"]["size"], b["row"]["size"]
        to_a = F.least((1 - a["p"]) * words_a, b["p"] * words_b)
        to_b = F.least(a["p"] * words_a, (1 - b["p"]) * words_b)
        moved = F.when(draw(b["row"], salt) * (to_a + to_b) < to_b, to_a).otherwise(-to_b)
        return F.array(unit(a, a["p"] + moved / words_a), unit(b, b["p"] - moved / words_b))

    def step(state, x):
        both = F.when(state["held"].isNull(), F.array(x)).otherwise(pair(state["held"], x))
        return let(both, lambda v: F.struct(
            F.get(F.filter(v, lambda y: (y["p"] > 0) & (y["p"] < 1)), F.lit(0)).alias("held"),
            F.concat(state["done"], F.filter(v, lambda y: (y["p"] == 0) | (y["p"] == 1))).alias("done"),
        ))

    start = F.struct(F.lit(None).cast(UNIT).alias("held"), F.array().cast(f"array<{UNIT}>").alias("done"))
    return F.aggregate(units, start, step)


def copies(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, ordinal, source, size, copies for every row of ``sizes`` with words, through the reduction tree."""
    wanted = sizes.where("size > 0").join(
        F.broadcast(targets) if targets.count() <= 100_000 else targets, sizes["source"].eqNullSafe(targets["source"])
    ).drop(targets["source"])
    rate = F.try_divide("target", "source_size")
    wanted = wanted.withColumn("whole", F.floor(rate + 1e-12).cast("int")).withColumn("p", F.greatest(rate - F.floor(rate + 1e-12), F.lit(0.0)))
    row = F.struct("doc_id", "ordinal", "source", "size")
    units = wanted.where("p > 1e-12").select("source", F.struct(row.alias("row"), F.col("p").alias("p")).alias("unit"))
    groups = units.groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("s"), F.ceil(F.col("n") / FAN_IN).cast("int").alias("groups"))
    top = groups.agg(F.max("groups")).first()[0] or 1
    units = units.join(groups, units["source"].eqNullSafe(groups["s"])).select(
        "source", "unit", F.pmod(F.xxhash64("unit.row.doc_id", "unit.row.ordinal"), F.col("groups")).cast("int").alias("part")
    )
    decided, level = wanted.where("p <= 1e-12").select(row.alias("row"), F.lit(0.0).alias("p")), 0
    larger_first = F.sort_array(F.collect_list(F.struct(F.col("unit.row.size").alias("size"), F.col("unit.row.doc_id").alias("d"), F.col("unit.row.ordinal").alias("o"), "unit")), asc=False)
    while True:
        folded = units.groupBy("source", "part").agg(larger_first.alias("u")).select("source", "part", pivot(F.transform("u", lambda x: x["unit"]), level).alias("r"))
        folded = stage(folded, f"mix-level{level}")
        decided = decided.unionByName(folded.select(F.explode("r.done").alias("x")).select("x.row", "x.p"))
        left = folded.where("r.held is not null").select("source", "part", F.col("r.held").alias("unit"))
        if top == 1:
            break
        level, top = level + 1, -(-top // FAN_IN)
        units = left.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
    last = left.select("unit.row", (draw(F.col("unit.row"), -1) < F.col("unit.p")).cast("double").alias("p"))
    decided = decided.unionByName(last)
    whole = targets.select(F.col("source").alias("s"), F.floor(F.try_divide("target", "source_size") + 1e-12).cast("int").alias("whole"))
    out = decided.select("row.*", "p")
    return out.join(whole, out["source"].eqNullSafe(whole["s"])).select("doc_id", "ordinal", "source", "size", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, ordinal of every row; the ordinal counts rows of the same id, source and size."""
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    same = Window.partitionBy("doc_id", "source", "size").orderBy("doc_id")
    return sizes.withColumn("ordinal", F.row_number().over(same))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row."""
    sizes = stage(measured(docs), "mix-sizes")
    targets = stage(source_targets(sizes, weights, share), "mix-targets")
    none = sizes.where("size = 0").select("doc_id", "source", "size", F.lit(0).alias("copies"))
    taken = copies(sizes, targets).select("doc_id", "source", "size", "copies").unionByName(none)
    t = F.broadcast(targets) if targets.count() <= 100_000 else targets
    return taken.join(t, taken["source"].eqNullSafe(t["source"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"), "copies"
    )


def resample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mix itself: each document as often as it is taken; all columns of ``docs`` are kept.

    Rows of one id, source and size are interchangeable: they share the copies those rows were given.
    """
    doc_id, source, words, ordinal, n, size, nth, copy = free_names(docs, "d", "s", "n", "o", "copies", "size", "ordinal", "copy")
    sizes = stage(measured(docs), "mix-sizes")
    given = copies(sizes, stage(source_targets(sizes, weights, share), "mix-targets")).where("copies > 0")
    given = given.toDF(doc_id, ordinal, source, words, n)
    numbered = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))
    numbered = numbered.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy("doc_id")))
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(size) == F.col(words)) & (F.col(nth) == F.col(ordinal))
    return numbered.join(given, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
