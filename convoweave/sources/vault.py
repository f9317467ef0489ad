"""Statistics of a folder of markdown notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vault_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "modificationTime", "length", F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix"), name.alias("name"), F.when(F.lower(name).endswith(".md"), F.try_validate_utf8(F.col("content").cast("string"))).alias("text"))


def vault_stats(files: DataFrame) -> DataFrame:
    md = F.col("suffix") == ".md"
    moc = md & F.lower("name").rlike("moc|index")
    words = F.size(F.array_remove(F.split("text", r"(?U)\s+"), ""))
    return files.agg(
        F.count("*").alias("files"), F.count_distinct(F.regexp_extract("path", r"^(.*)/", 1)).alias("folders"), F.sum("length").alias("bytes"), F.count_if(md).alias("notes"), F.count_if(moc).alias("mocs"),
        F.sum(words).alias("words"), F.sum(F.regexp_count("text", F.lit(r"(?U)#([\w/]+)"))).alias("tags"),
        F.sum(F.regexp_count("text", F.lit(r"\[\[(.*?)\]\]"))).alias("links"),
        F.min(F.when(md, F.col("modificationTime"))).alias("oldest"), F.max(F.when(md, F.col("modificationTime"))).alias("newest"),
    )


def vault_tags(files: DataFrame, k: int = 10) -> DataFrame:
    found = files.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?U)#([\w/]+)"), F.lit(1))).alias("tag"))
    return found.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def vault_suffixes(files: DataFrame) -> DataFrame:
    """(suffix, n) of all files."""
    return files.groupBy("suffix").agg(F.count("*").alias("n"))
