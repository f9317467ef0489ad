"""Fill-in-the-middle documents, cut between units (lines by default) with relational steps.

Every text becomes its units, the matches of a pattern from left to right. Their lengths are exploded with their places, a
window sums them up, each document's two cut requests join the units by ordinal, the offsets found are gathered for each
document, and substrings of the text make prefix, middle and suffix. Lengths and offsets are in code points.

A document is known by 128 bits of its id and text, so rows that repeat both are cut once and alike, however many they are;
the lengths of a document travel as one slim row, and its text once, to meet its offsets. No row is dropped.

A null text counts as empty; empty texts, and texts that hold a mark, stay plain; a null id draws as an empty one would. A
text of many units, or in one piece, is cut like any other. Other columns are kept under their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoweave.llm.text import free_names, let
from convoweave.shared import stage

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = "7:", 100, 50


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers of 32 bits, fixed by the seed and the id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def unit_ends(lengths: DataFrame) -> DataFrame:
    """(key, doc_id, unit, n, end) of (key, doc_id, lengths): each unit from 1, the document's units, the offset behind it."""
    units = lengths.select("key", "doc_id", F.posexplode("lengths").alias("at", "length"))
    whole = Window.partitionBy("key")
    return units.select(
        "key", "doc_id", (F.col("at") + 1).alias("unit"), F.count("*").over(whole).alias("n"),
        F.sum("length").over(whole.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
    )


def offsets(docs: DataFrame, key: Column, pattern: str = LINES, seed: str = SEED) -> DataFrame:
    """(key, n, first, second) of documents with units: their number and the offsets of both cuts."""
    text = F.coalesce("text", F.lit(""))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    lengths = docs.select(key.alias("key"), "doc_id", found.alias("lengths")).groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.first("lengths").alias("lengths"))
    ends = unit_ends(lengths)
    h = draws(F.col("doc_id"), seed)
    cuts = [F.pmod(h[k], F.col("n") + 1) for k in (0, 1)]
    requests = ends.where("unit = 1").select("key", "n", F.explode(F.array(F.struct(F.lit("first").alias("cut"), F.least(*cuts).alias("units")), F.struct(F.lit("second").alias("cut"), F.greatest(*cuts).alias("units")))).alias("r"))
    requests = requests.select("key", "n", "r.*")
    # Both sides are dealt by key alone; the ordinal is held as a range, so the units are not dealt again by key and ordinal.
    met = requests.alias("r").join(ends.select("key", "unit", "end").alias("e").hint("merge"), (F.col("r.key") == F.col("e.key")) & F.col("e.unit").between(F.greatest("r.units", F.lit(1)), F.greatest("r.units", F.lit(1))))
    offset = F.when(F.col("units") == 0, 0).otherwise(F.col("end"))
    at = lambda cut: F.max(F.when(F.col("cut") == cut, offset)).alias(cut)
    return met.groupBy(F.col("r.key").alias("key")).agg(F.max("n").alias("n"), at("first"), at("second"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from: its parts lie between the first places of the marks."""

    def between(x: Column, after: str, before: str | None) -> Column:
        start = F.locate(after, x) + len(after)
        return F.substring(x, start, (F.locate(before, x) if before else F.length(x) + 1) - start)

    psm = let(output, lambda x: F.concat(between(x, PREFIX, SUFFIX), between(x, MIDDLE, None), between(x, SUFFIX, MIDDLE)))
    spm = let(output, lambda x: F.concat(between(x, PREFIX, MIDDLE), between(x, MIDDLE, None), between(x, SUFFIX, PREFIX)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, pattern: str = LINES, seed: str = SEED) -> DataFrame:
    """The columns of ``docs`` and, last, a struct (n, form, prefix_chars, middle_chars, output).

    ``rate`` of 100 documents are transformed, ``spm`` of 100 of these with the suffix first. The struct is named _fim, or with
    more underscores if a column of that name is there.
    """
    key, k, n, first, second, form, fim = free_names(docs, "key", "k", "n", "first", "second", "form", "fim")
    hashed = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))))
    cut = stage(offsets(docs, hashed, pattern, seed), "unit-offsets").toDF(k, n, first, second)
    joined = docs.withColumn(key, hashed).join(cut.hint("merge"), F.col(key) == F.col(k), "left").withColumn(n, F.coalesce(n, F.lit(0)).cast("bigint"))
    text, h = F.coalesce("text", F.lit("")), draws(F.col("doc_id"), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (F.col(n) == 0) | marked | (F.pmod(h[2], F.lit(100)) >= rate)
    chosen = joined.withColumn(form, F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < spm, "spm").otherwise("psm"))
    part = lambda start, end: F.substring(text, start + 1, end - start)
    prefix, middle, suffix = part(F.lit(0), F.col(first)), part(F.col(first), F.col(second)), part(F.col(second), F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    swapped = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", swapped).otherwise(text)
    cut_only = lambda x: F.when(F.col(form) != "plain", x).cast("bigint")
    told = F.struct(F.col(n).alias("n"), F.col(form).alias("form"), cut_only(F.col(first)).alias("prefix_chars"), cut_only(F.col(second) - F.col(first)).alias("middle_chars"), output.alias("output"))
    return chosen.select(*docs.columns, told.alias(fim))


def query(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    fim = made.columns[-1]
    return made.select(
        "doc_id", F.col(f"{fim}.n"), F.col(f"{fim}.form"), F.col(f"{fim}.prefix_chars"), F.col(f"{fim}.middle_chars"),
        F.sha2(F.col(f"{fim}.output"), 256).alias("output_sha256"), F.sha2(restore(F.col(f"{fim}.output"), F.col(f"{fim}.form")), 256).alias("restored_sha256"),
    )


SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
h AS (SELECT *, len(units)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(pre || mid || suf) AS restored_sha256 FROM p"""
