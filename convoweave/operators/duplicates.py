"""Near duplicates: which rows are so like an earlier one that only the earlier one should stay.

Rows go by ascending id. A row stays unless a row that stays is like it (Jaccard similarity of the word sets of ``threshold`` or
more); then it belongs to the least such row. So every row that goes is like the one it belongs to, and no two rows that
stay are alike. Rows of equal sets are one row until the end. Rows without words stay and are like nothing.

``near_duplicates`` finds candidates by MinHash bands and checks each by exact intersection. All pairs of a bucket are never
made: in each round the least undecided row of all its buckets is certain to stay, and only its buckets' rows are held
against it, so a family of many near copies takes one round and a row for each copy and band.
``exact_duplicates`` takes the pairs of ``similarity_join``, which misses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoweave.operators.graph import similarity_join
from convoweave.shared import discard, stage

THRESHOLD = 0.85
#: 32 bands of 10 values find a pair at 0.85 with probability 0.999, at 0.95 with 1 - 1e-12; at 0.5 one in thirty is a candidate, at
#: 0.15, where unlike documents of a language are, one in five million, so that chance candidates do not grow with the square.
BANDS, ROWS = 32, 10


def word_sets(words: DataFrame) -> DataFrame:
    """(id, set) of (id, word) or (id, words), an array: distinct words as sorted 64-bit hashes, staged; rows without words have none."""
    if "words" in words.columns:
        parts = words.where(F.size("words") > 0).select("id", F.array_distinct(F.transform("words", lambda w: F.xxhash64(w))).alias("w"))
        sets = parts.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("set"))
    else:
        hashed = words.where("word is not null").select("id", F.xxhash64("word").alias("w"))
        sets = hashed.groupBy("id").agg(F.array_sort(F.collect_set("w")).alias("set"))
    return stage(sets, "word-sets")


def signature_bands(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, bucket) of (id, set), no set empty: a bucket for each band of ``rows`` minima of hash functions of the set."""
    seeds = np.random.default_rng(11).integers(0, 2**64, (2, bands * rows), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, n = batch.column("set").flatten().to_numpy().view(np.uint64), batch.column("set").value_lengths().to_numpy()
            if not len(n):
                continue
            starts = np.cumsum(n) - n
            for b in range(bands):
                bucket = np.full(len(n), b, np.uint64)
                for k in range(b * rows, (b + 1) * rows):
                    least = np.minimum.reduceat((hashes ^ seeds[0, k]) * (seeds[1, k] | np.uint64(1)), starts)
                    bucket = (bucket ^ least ^ (bucket >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((bucket ^ (bucket >> np.uint64(32))).view(np.int64))], names=["id", "bucket"])

    return sets.select("id", "set").mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, bucket bigint")


def _likeness(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, owner, similarity) of pairs (id, owner)."""
    a, b = sets.select("id", F.col("set").alias("s")), sets.select(F.col("id").alias("owner"), F.col("set").alias("t"))
    shared = F.size(F.array_intersect("s", "t"))
    return pairs.join(a, "id").join(b, "owner").select("id", "owner", (shared / (F.size("s") + F.size("t") - shared)).alias("similarity"))


def _spread(classes: DataFrame, decided: DataFrame) -> DataFrame:
    """(id, keep_id, similarity, kept) of every row from its class's decision (id, owner, similarity)."""
    told = classes.join(decided.withColumnRenamed("id", "one"), "one")
    return told.select("id", F.col("owner").alias("keep_id"), F.round("similarity", 6).alias("similarity"), (F.col("id") == F.col("owner")).alias("kept"))


def _classes(sets: DataFrame) -> DataFrame:
    """(id, one): the least row of equal sets."""
    same = sets.select("id", F.size("set").alias("n"), F.xxhash64("set", F.lit(7)).alias("h"), F.xxhash64(F.reverse("set")).alias("g"))
    least = same.groupBy("n", "h", "g").agg(F.min("id").alias("one"))
    return stage(same.join(least, ["n", "h", "g"]).select("id", "one"), "equal-sets")


def _alone(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the rows without words, which stay."""
    rest = ids.select("id").distinct().join(found.select("id"), "id", "left_anti")
    return found.unionByName(rest.select("id", F.col("id").alias("keep_id"), F.lit(1.0).alias("similarity"), F.lit(True).alias("kept")))


def near_duplicates(words: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, keep_id, similarity, kept) of every id of (id, word) or (id, words); a null word or no words stand for a row without words."""
    sets = word_sets(words)
    classes = _classes(sets)
    ones = classes.where("id = one").select("id")
    buckets = stage(signature_bands(sets.join(ones, "id", "left_semi"), bands, rows), "buckets")
    met = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    left = stage(buckets.join(met, "bucket", "left_semi"), "open-buckets")
    discard(buckets)
    open_ids = left.select("id").distinct()
    alone = ones.join(open_ids, "id", "left_anti")
    compared = stage(sets.join(open_ids, "id", "left_semi"), "compared-sets")  # most rows are like nothing and go no further
    decided = [stage(alone.select("id", F.col("id").alias("owner"), F.lit(1.0).alias("similarity")), "decided")]
    while left.head(1):
        first = left.groupBy("bucket").agg(F.min("id").alias("owner"))
        seen = stage(left.join(first, "bucket"), "bucket-owners")  # (bucket, id, owner)
        owners = seen.groupBy("id").agg(F.min(F.col("id") == F.col("owner")).alias("safe")).where("safe").select("id")
        pairs = seen.where("id <> owner").join(owners.withColumnRenamed("id", "owner"), "owner", "left_semi").select("id", "owner").distinct()
        alike = _likeness(pairs, compared).where(F.col("similarity") >= threshold)
        gone = alike.groupBy("id").agg(F.min(F.struct("owner", "similarity")).alias("x")).select("id", "x.owner", "x.similarity")
        now = stage(gone.unionByName(owners.select("id", F.col("id").alias("owner"), F.lit(1.0).alias("similarity"))), "decided")
        decided.append(now)
        left, old = stage(left.join(now.select("id"), "id", "left_anti"), "open-buckets"), left
        discard(old)
        discard(seen)
    every = decided[0]
    for d in decided[1:]:
        every = every.unionByName(d)
    return _alone(words, _spread(classes, every))


def exact_duplicates(words: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The same from all pairs that are alike, none missed."""
    sets = word_sets(words)
    classes = _classes(sets)
    ones = classes.where("id = one").select("id")
    inner = words.where("word is not null").join(ones, "id", "left_semi")
    links = stage(similarity_join(inner, threshold), "alike")  # src < dst
    open_, decided = stage(ones, "open-rows"), []
    while open_.head(1):
        alive = links.join(open_.withColumnRenamed("id", "src"), "src", "left_semi").join(open_.withColumnRenamed("id", "dst"), "dst", "left_semi")
        owners = stage(open_.join(alive.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"), "owners")
        near = alive.join(owners.withColumnRenamed("id", "src"), "src", "left_semi")
        gone = near.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("src", "weight")).alias("x")).select("id", F.col("x.src").alias("owner"), F.col("x.weight").alias("similarity"))
        now = stage(gone.unionByName(owners.select("id", F.col("id").alias("owner"), F.lit(1.0).alias("similarity"))), "decided")
        decided.append(now)
        open_, old = stage(open_.join(now.select("id"), "id", "left_anti"), "open-rows"), open_
        discard(old)
    every = ones.limit(0).select("id", F.col("id").alias("owner"), F.lit(1.0).alias("similarity"))
    for d in decided:
        every = every.unionByName(d)
    return _alone(words, _spread(classes, every))
