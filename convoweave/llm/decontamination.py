"""Benchmark decontamination by size-partitioned MinHash containment search, verified by exact containment.

Texts are cut into words (runs of letters and digits) and these lower-cased; an item's set is its distinct runs of
``SHINGLE`` words. Items are dealt to partitions by the power of two of their set's size. A partition of sizes
up to ``u`` keeps of each item the ``floor((1 - threshold) * u) + 1`` shingles of least hash (a bottom-k MinHash
sketch, or all if there are fewer). A document that contains ``threshold`` of an item lacks too few shingles to
miss the whole sketch, so testing the sketch's hashes for membership in the document's full set misses nothing,
however long the document. Each candidate is then verified on the shingles themselves.

An item with fewer than ``SHINGLE`` words is one shingle, the run of all its words, and is searched as such; items without
words (null and empty texts too) are not searched. Rows repeating an id are searched each, and the fullest one is reported; rows with a null id as well. Inside
the module a row is known by a hash of its id and text, and removed by it. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoweave.llm.text import free_names, let, row_key, window_hashes
from convoweave.shared import stage

SHINGLE = 5
THRESHOLD_PERCENT = 80
#: The sketch index is broadcast up to this many rows (about 50 bytes each), else joined by shuffle.
BROADCAST_ROWS = 500_000


def normal_words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), ""), lambda x: F.lower(x))


def shingles(w: Column, n: int) -> Column:
    """Distinct shingles of ``n`` words as texts, built only for candidates."""
    return let(
        w,
        lambda v: F.when(
            F.size(v) >= n,
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(v) - (n - 1)), lambda i: F.array_join(F.slice(v, i, n), " "))),
        ).otherwise(F.array().cast("array<string>")),
    )


def sketch_index(items: DataFrame, n: int = SHINGLE, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(h, item_key): the sketch of every item, its depth fixed by the item's size partition."""
    sets = (
        items.withColumn("w", normal_words(F.col("text")))
        .withColumn("hashes", F.sort_array(F.array_distinct(window_hashes(F.col("w"), n))))
        .where(F.size("hashes") > 0)
    )
    top = F.pow(F.lit(2), F.floor(F.log2(F.size("hashes"))) + 1) - 1
    depth = (F.floor(top * (100 - threshold_percent) / 100) + 1).cast("int")
    return sets.select("item_key", F.explode(F.slice("hashes", F.lit(1), depth)).alias("h"))


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """key (of the row), doc_id, item_id, n_item_shingles, n_shared, containment of every pair at or above the threshold."""
    words_of = F.least(F.size(normal_words(F.col("text"))), F.lit(SHINGLE))
    items = benchmark.select("item_id", "text", words_of.alias("run")).where("run > 0").distinct()
    items = stage(items.withColumn("item_key", F.xxhash64("item_id", "text")), "benchmark-items")
    runs = {r["run"] for r in items.select("run").distinct().collect()} | {SHINGLE}  # SHINGLE values at most
    out = None
    for n in sorted(runs):
        part = contaminated_by(docs, items.where(F.col("run") == n), n, threshold_percent)
        out = part if out is None else out.unionByName(part)
    return out


def contaminated_by(docs: DataFrame, items: DataFrame, n: int, threshold_percent: int) -> DataFrame:
    """The same for items whose shingles have ``n`` words."""
    index = stage(sketch_index(items, n, threshold_percent), "benchmark-sketches")
    small = index.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    hashed = docs.select(row_key().alias("key"), normal_words(F.col("text")).alias("w")).select(
        "key", F.explode(window_hashes(F.col("w"), n)).alias("h")
    )
    pairs = stage(hashed.join(hint(index), "h").select("key", "item_key").distinct(), "benchmark-candidates")
    item_sets = items.select("item_id", "item_key", shingles(normal_words(F.col("text")), n).alias("item_set"))
    wanted = pairs.groupBy("key").agg(F.collect_list("item_key").alias("keys"))
    texts = docs.select("doc_id", "text", row_key().alias("key")).join(wanted, "key")
    sets = texts.select("key", "doc_id", shingles(normal_words(F.col("text")), n).alias("doc_set"), F.explode("keys").alias("item_key"))
    return (
        sets.join(hint(item_sets), "item_key")
        .select("key", "doc_id", "item_id", F.size("item_set").cast("bigint").alias("n_item_shingles"), F.size(F.array_intersect("doc_set", "item_set")).cast("bigint").alias("n_shared"))
        .where(100 * F.col("n_shared") >= threshold_percent * F.col("n_item_shingles"))
        .withColumn("containment", F.round(F.col("n_shared") / F.col("n_item_shingles"), 6))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of every pair at or above the threshold."""
    return (
        contaminated_rows(docs, benchmark, threshold_percent)
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("n_item_shingles", "n_shared", "containment"), "containment").alias("x"))
        .select("doc_id", "item_id", "x.*")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows without those that contain a benchmark item; others that share an id with one, or have none, stay."""
    (key,) = free_names(docs, "key")
    bad = stage(contaminated_rows(docs, benchmark).select(F.col("key").alias(key)).distinct(), "benchmark-rows")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad  # else both sides are exchanged
    return docs.withColumn(key, row_key()).join(bad, key, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = rf"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, list_transform(list_filter(string_split_regex(coalesce(text, ''), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), lambda x: lower(x)) AS w FROM documents),
iw AS (SELECT item_id, w, least({SHINGLE}, len(w)) AS k FROM (SELECT item_id, list_transform(list_filter(string_split_regex(coalesce(text, ''), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), lambda x: lower(x)) AS w FROM benchmark) WHERE len(w) > 0),
ds AS (SELECT DISTINCT r, doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM iw))),
its AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM iw)),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM its GROUP BY item_id),
found AS (SELECT r, doc_id, item_id, n_item_shingles, count(*) AS n_shared FROM ds JOIN its USING (k, s) JOIN n USING (item_id)
          GROUP BY r, doc_id, item_id, n_item_shingles HAVING 100 * count(*) >= {THRESHOLD_PERCENT} * n_item_shingles)
SELECT doc_id, item_id, n_item_shingles, max(n_shared) AS n_shared, round(max(n_shared) / n_item_shingles, 6) AS containment
FROM found GROUP BY doc_id, item_id, n_item_shingles
"""
