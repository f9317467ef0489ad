"""Exact duplicates: rows whose texts are equal when all white space characters are taken out.

Rows are grouped by a 128-bit hash of the bare text, one row of each group stays, and bytes are compared inside groups: the
distinct pairs of hash and bare text are formed (copies are combined where they lie, before anything is sent, so a group of
any size sends one text for each input partition), and a hash that has more than one text is a collision, whose texts get
numbers of their own. So groups are exact, whatever the hash does.

Of a group the row with the most code points stays, then that of the least id (null ids last), then that of the least hash
of the whole row, in the end the first one of the staged table. A null text counts as empty; empty and blank texts are equal,
so they are one group like any other. Very long texts are hashed and compared whole. Other columns are kept under their
names; an empty table gives an empty result. Only slim rows are joined to their groups; hot groups are split by the adaptive
skew join, as both sides come straight from written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.llm.text import free_names
from convoweave.shared import stage

BLANKS = " \t\n\v\f\r"


def bare(text: Column) -> Column:
    """The text without space, \\t, \\n, \\v, \\f and \\r; empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def collisions(texts: DataFrame, digest: Column) -> DataFrame:
    """(h, text, variant): texts of (text) that share a hash with another, numbered from 0 in byte order; none, as a rule."""
    variants = texts.select(digest.alias("h"), "text").distinct()
    shared = variants.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    several = stage(shared, "shared-hashes")
    if several.isEmpty():
        return several.limit(0).select("h", F.lit("").alias("text"), F.lit(0).alias("variant"))
    place = F.row_number().over(Window.partitionBy("h").orderBy("text")) - 1
    return stage(variants.join(several, "h", "left_semi").withColumn("variant", place), "collisions")


def grouped(docs: DataFrame, hashed=hash128) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, digest) of every row; ``hashed`` makes the group's hash of the bare text.

    ``row`` is the row's ``row_hash``; ``digest`` is the bare text's sha256 in lowercase hex.
    """
    text = bare(F.col("text"))
    found = collisions(docs.select(text.alias("text")), hashed(F.col("text")))
    base = docs.select("doc_id", row_hash(docs).alias("row"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"), text.alias("text")).withColumn("h", hashed(F.col("text")))
    if found.isEmpty():
        base = base.withColumn("variant", F.lit(0))
    else:
        base = base.join(found.withColumnRenamed("variant", "v"), ["h", "text"], "left").withColumn("variant", F.coalesce("v", F.lit(0)))
    slim = base.select("doc_id", "row", "chars", "h", "variant", F.unhex(F.sha2("text", 256)).alias("digest"), F.monotonically_increasing_id().alias("place"))
    rows = stage(slim, "copy-rows")
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row", "place")).alias("best")
    groups = stage(rows.groupBy("h", "variant").agg(F.count("*").alias("group_size"), best), "copy-groups")
    joined = rows.join(groups.hint("merge"), ["h", "variant"])
    return joined.select("row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("best.place")).alias("kept"), F.lower(F.hex("digest")).alias("digest"))


def row_hash(docs: DataFrame) -> Column:
    """128 bits of all columns of a row that have an order."""
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    return F.struct(F.xxhash64(*plain).alias("a"), F.xxhash64(F.lit(1), *plain).alias("b"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows equal in every column one stays."""
    row, wanted = free_names(docs, "row", "wanted")
    stays = grouped(docs).where("kept").select(F.col("row").alias(wanted))
    found = docs.withColumn(row, row_hash(docs)).join(stays.hint("merge"), F.col(row) == F.col(wanted), "left_semi")
    return found.dropDuplicates([row]).select(*[f"`{c}`" for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = grouped(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
r AS (SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM d WINDOW w AS (PARTITION BY bare ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(bare) AS text_sha256 FROM r"""
