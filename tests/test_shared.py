"""What staging leaves behind."""

import time

from pyspark.sql import functions as F

from convoweave.shared import discard, stage


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}


def test_staging_leaves_no_shuffle_files(spark):
    made = spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    before, out = shuffle_files(spark), stage(made, "cleaned")
    for _ in range(20):  # files are removed beside the query
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.5)
    assert not left and out.count() == 100 and made.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    discard(out)
