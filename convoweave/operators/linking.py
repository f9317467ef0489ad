"""Link recommendation: direct and two-hop candidates, top-k, backlinks, neighbours in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.operators.graph import both_ways, topk
from convoweave.shared import discard, stage

# Limits and weights of links.
RELATED, CONCEPTS, MIN_SCORE, INDIRECT, BOOST = 10, 15, 0.3, 0.3, 0.1


def direct(edges: DataFrame) -> DataFrame:
    return both_ways(edges, "weight", "relationship").select("src", "dst", F.col("weight").alias("score"), "relationship")


def indirect(term_edges: DataFrame, shared: bool = False) -> DataFrame:
    """Two hops over a shared term of (id, term, weight): each path adds 0.3 times both weights; ``shared`` lists the terms."""
    a, b = (term_edges.select(F.col("id").alias(x), "term", F.col("weight").alias(f"w_{x}")) for x in ("src", "dst"))
    terms = [F.array_join(F.array_sort(F.collect_list("term")), ",").alias("shared")] if shared else []
    return a.join(b, "term").where("src <> dst").groupBy("src", "dst").agg(F.round(F.sum(INDIRECT * F.col("w_src") * F.col("w_dst")), 6).alias("score"), F.count("*").alias("paths"), *terms)


def concept_links(concepts: DataFrame, nodes: DataFrame, k: int = CONCEPTS) -> DataFrame:
    """(conv_id, term, score, rank) of (conv_id, term): importance times a boost by occurrences; unknown terms score 0.

    ``nodes``: (term, importance, n).
    """
    score = F.round(F.coalesce("importance", F.lit(0)) * (1 + BOOST * F.coalesce("n", F.lit(0))), 6)
    return topk(concepts.join(nodes, "term", "left").select("conv_id", "term", score.alias("score")), ["conv_id"], [F.desc("score"), F.col("term")], k)


def metadata(links: DataFrame) -> DataFrame:
    """(conv_id, link_scores) of (conv_id, rank, title, strength): a map by title; of equal titles the last one stays."""
    one = links.groupBy("conv_id", "title").agg(F.max_by("strength", "rank").alias("strength"))
    return one.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("title", "strength"))).alias("link_scores"))


def leaders(conv: DataFrame, links: DataFrame, k: int = 5) -> DataFrame:
    """(conv_id, related, backlinks) of the conversations with the most links in both directions."""
    out = links.groupBy(F.col("src").alias("conv_id")).agg(F.count("*").alias("related"))
    back = links.groupBy(F.col("dst").alias("conv_id")).agg(F.count("*").alias("backlinks"))
    both = conv.select("conv_id").join(out, "conv_id", "left").join(back, "conv_id", "left").select("conv_id", F.coalesce("related", F.lit(0)).alias("related"), F.coalesce("backlinks", F.lit(0)).alias("backlinks"))
    return both.orderBy((F.col("related") + F.col("backlinks")).desc(), "conv_id").limit(k)


def candidates(edges: DataFrame, term_edges: DataFrame) -> DataFrame:
    one, two = direct(edges), indirect(term_edges).select("src", "dst", F.col("score").alias("more"))
    return one.join(two, ["src", "dst"], "full_outer").select(
        "src", "dst", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("more", F.lit(0.0)), 6).alias("score"), F.coalesce("relationship", F.lit("indirect")).alias("relationship")
    )


def related(found: DataFrame, k: int = RELATED, least: float = MIN_SCORE) -> DataFrame:
    return topk(found.where(F.col("score") >= least), ["src"], [F.desc("score"), F.col("dst")], k)


def in_sequence(conv: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("created_at", "conv_id")
    return conv.select("conv_id", F.lag("title").over(w).alias("previous_title"), F.lead("title").over(w).alias("next_title"))


def backlinks(links: DataFrame, conv: DataFrame) -> DataFrame:
    """(conv_id, backlinks): titles of the conversations that link to it, in order; a title belongs to its first owner."""
    owners = conv.groupBy("title").agg(F.min("conv_id").alias("owner"))
    titled = links.join(conv.select(F.col("conv_id").alias("dst"), "title"), "dst").join(owners, "title")
    named = titled.join(conv.select(F.col("conv_id").alias("src"), F.col("title").alias("source_title")), "src")
    return named.groupBy(F.col("owner").alias("conv_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("src", "source_title"))), lambda x: x["source_title"]), " / ").alias("backlinks"))


# Top-k two-hop links without all pairs of a common term -----------------------------------------------------------

#: Terms of more conversations than this are common; their first stride has BLOCK postings; strides of a round.
COMMON, BLOCK, STRIDES = 64, 16, 3


def postings(often: DataFrame) -> DataFrame:
    """(term, id, weight, stride) of common terms: by falling weight, then id, in strides of 16, 16, 32, 64, ... postings.

    Places are counted inside ranges of (term, weight, id) and shifted by the counts of a term's earlier ranges, so a term that
    every conversation has is sorted by many tasks. A term has at most as many strides as its size has bits.
    """
    n = int(often.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("weight"), F.asc("id")]
    dealt = stage(often.select("term", "id", "weight").repartitionByRange(n, F.asc("term"), *order).withColumn("range", F.spark_partition_id()), "posting-ranges")
    counts = dealt.groupBy("term", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("term").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("term", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = dealt.withColumn("place", F.row_number().over(Window.partitionBy("term", "range").orderBy(*order)) - 1)
    place = F.floor((F.col("offset") + F.col("place")) / BLOCK)
    return inside.join(offsets, ["term", "range"]).select("term", "id", "weight", F.when(place == 0, 0).otherwise(F.floor(F.log2(F.greatest(place, F.lit(1))) + 1e-12) + 1).cast("int").alias("stride"))


def common_scores(pairs: DataFrame, often: DataFrame) -> DataFrame:
    """(src, dst, more): what common terms add to each of ``pairs`` (src, dst); pairs without any have no row."""
    a = often.select(F.col("id").alias("src"), "term", F.col("weight").alias("w_src"))
    b = often.select(F.col("id").alias("dst"), "term", F.col("weight").alias("w_dst"))
    return pairs.join(a, "src").join(b, ["dst", "term"]).groupBy("src", "dst").agg(F.sum(INDIRECT * F.col("w_src") * F.col("w_dst")).alias("more"))


def _best(found: DataFrame, k: int, least: float) -> DataFrame:
    once = found.where(F.col("score") >= least).groupBy("src", "dst").agg(F.max(F.struct("score", (F.col("relationship") != "indirect").alias("known"), "relationship")).alias("x"))
    return related(once.select("src", "dst", "x.score", "x.relationship"), k, least)


def _reaches(bound: Column) -> Column:
    """Whether something of at most ``bound`` could still be among the best; ties go to lesser ids."""
    rounded = F.round(bound + 1e-9, 6)
    return (rounded > F.col("floor")) | ((rounded == F.col("floor")) & (F.col("last").isNull() | (F.col("first_id") < F.col("last"))))


def top_related(edges: DataFrame, term_edges: DataFrame, k: int = RELATED, least: float = MIN_SCORE, common: int = COMMON) -> DataFrame:
    """What ``related(candidates(edges, term_edges), k, least)`` gives, without making all pairs of a common term.

    Pairs of direct edges and of rare terms are made and scored outright, and each conversation with the first stride of its
    common terms. That gives every source a k-th best score so far. A conversation met only through common terms scores at
    most the sum, over the source's common terms, of both weights with the term's greatest in place of its own; a stride of a
    term can be left out when even its own greatest weight, with the others' greatest, stays below the source's k-th best. What
    belongs to the best is in no stride left out, so the result is exact. Strides grow twofold and are visited in rounds,
    each of which raises the bound. Weights must not be negative.
    """
    terms = stage(term_edges.select("id", "term", "weight"), "link-terms")
    sizes = terms.groupBy("term").agg(F.count("*").alias("n"), F.max("weight").alias("most"))
    sized = stage(terms.join(sizes, "term"), "link-sized")
    rare, often = sized.where(F.col("n") <= common), sized.where(F.col("n") > common)
    lists = stage(postings(often), "link-postings")

    a, b = (rare.select(F.col("id").alias(x), "term", F.col("weight").alias(f"w_{x}")) for x in ("src", "dst"))
    few = a.join(b, "term").where("src <> dst").groupBy("src", "dst").agg(F.sum(INDIRECT * F.col("w_src") * F.col("w_dst")).alias("rare"))
    seeds = often.select(F.col("id").alias("src"), "term").join(lists.where("stride = 0").select("term", F.col("id").alias("dst")), "term").where("src <> dst").select("src", "dst")
    known = direct(edges).join(few, ["src", "dst"], "full_outer")
    every = stage(known.join(seeds.distinct(), ["src", "dst"], "full_outer"), "link-pairs")
    first = every.join(common_scores(every.select("src", "dst"), often), ["src", "dst"], "left")
    hops = F.round(F.coalesce("rare", F.lit(0.0)) + F.coalesce("more", F.lit(0.0)), 6)
    scored = first.select("src", "dst", F.round(F.coalesce("score", F.lit(0.0)) + hops, 6).alias("score"), F.coalesce("relationship", F.lit("indirect")).alias("relationship"))
    best = stage(_best(scored, k, least), "link-best")

    strides = stage(lists.groupBy("term", "stride").agg(F.max("weight").alias("top"), F.min("id").alias("first_id")).where("stride > 0"), "link-strides")
    whole = often.groupBy(F.col("id").alias("src")).agg(F.sum(INDIRECT * F.col("weight") * F.col("most")).alias("all"))
    mine = stage(often.select(F.col("id").alias("src"), "term", "weight", "most").join(whole, "src"), "link-bounds")
    last = strides.agg(F.max("stride")).first()[0] or 0
    for start in range(1, last + 1, STRIDES):
        floors = best.where(F.col("rank") == k).select("src", F.col("score").alias("floor"), F.col("dst").alias("last"))
        open_ = mine.join(floors, "src", "left").withColumn("floor", F.coalesce("floor", F.lit(float(least))))
        tried = open_.join(strides.where(F.col("stride") >= start), "term").where(_reaches(F.col("all") - INDIRECT * F.col("weight") * (F.col("most") - F.col("top"))))
        if not tried.head(1):
            break
        now = tried.where(F.col("stride") < start + STRIDES).select("src", "term", "stride")
        met = now.join(lists.select("term", "stride", F.col("id").alias("dst")), ["term", "stride"]).where("src <> dst").select("src", "dst").distinct()
        more = common_scores(met, often).select("src", "dst", F.round("more", 6).alias("score"), F.lit("indirect").alias("relationship"))
        best, old = stage(_best(best.drop("rank").unionByName(more), k, least), "link-best"), best
        discard(old)
    return best
