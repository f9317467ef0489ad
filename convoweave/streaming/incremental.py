"""Incremental ingestion: only conversations that were not seen before go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convoweave.sources.exports import parsed


def ingest(spark: SparkSession, folder: str, table_path: str, checkpoint: str, delay: str = "400 days") -> StreamingQuery:
    """Appends new conversations of the export files in ``folder`` to the Parquet table; each id once within ``delay``."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    rows = parsed(files).where("error IS NULL").withColumn("event_time", F.coalesce("created_at", F.current_timestamp()))
    fresh = rows.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["conv_id"])

    def append(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(table_path)

    return fresh.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
