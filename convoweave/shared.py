"""Tables written to the folder that the driver and all executors share.

The folder is the session's ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``. Only where both are unset
and everything runs on one machine (a local master, as in tests) a folder below the system's temporary one is taken.
A staged table cuts the lineage and survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULT = "file:///tmp/checkpoints/convoweave"
#: Spark removes a query's shuffle files as it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_staged: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also makes ``checkpoint()`` usable."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL_DEFAULT
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/convoweave-{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_remove_staged)
    _staged[path] = spark
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; the shuffle files of the write go at once."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that ``stage`` returned; whatever was made from it must be staged itself by now."""
    path = df.staged_at
    _remove(_staged.pop(path), path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Removes the tables staged inside when it ends, but for those whose path is added to the set it gives."""
    before, kept = set(_staged), set()
    yield kept
    for path in set(_staged) - before - kept:
        _remove(_staged.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_staged() -> None:
    for path, spark in _staged.items():
        try:
            _remove(spark, path)
        except Exception:  # the session is already gone: the cluster's own cleaning takes over
            return
