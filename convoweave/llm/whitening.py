"""Whitening of embeddings: principal components scaled to unit variance, from statistics that are merged pair by pair.

Every task reduces its vectors to a count, their mean and their scatter about that mean (Chan, Golub and LeVeque's form, so no
large sums of squares are subtracted from each other); a tree of merges gives those of the whole table, and only its last few,
each of the size of one matrix, reach the driver, which solves the eigenvalue problem. A second pass over the table forms the
same statistics of the whitened vectors and holds their covariance against the identity.

Entries become integers, floor(64 * entry) + 1000000, so sums are exact; each distinct vector counts once in the fit, copies
being combined before they are sent. Rows whose vector is null, has a null, a NaN or an infinite entry, or an entry beyond
2**50 units, are dropped; so are empty vectors, and those of another length than the most common one (of equally common ones
the longest). All other rows are returned, repeated ones and those without an id too. Components without variance (an
eigenvalue no larger than rounding leaves) have null whitened values and are not part of the identity. If all vectors are
equal, all components are such. An empty table gives an empty result. Extra columns are ignored by ``whiten``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoweave.shared import stage

UNIT, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries beyond this many units are no embeddings; below it, their numbers are exact.
LARGEST = 2.0**50
#: Statistics that meet in one task of the tree of merges, so also the number that reaches the driver.
FAN_IN = 32


@dataclass(frozen=True)
class Whitening:
    """What a table's fit gives: n vectors with sums S, the mean, and for each component its axis and eigenvalue."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    axes: np.ndarray  # dimension x components, unit columns
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = math.nan

    @property
    def scales(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(self.eigenvalues > 0, 1 / np.sqrt(self.eigenvalues), np.nan)


def as_integers(vector: Column) -> Column:
    """The vector in whole units; null if it is null, empty, or has an entry that is null, not finite or too large."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * UNIT <= LARGEST, F.lit(False)) & ~F.isnan(c.cast("double")))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * UNIT) + SHIFT))


def matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of equally long lists without nulls as rows of a matrix."""
    if not batch.num_rows:
        return np.zeros((0, 0))
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


Stats = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def statistics_of(x: np.ndarray) -> Stats:
    """(n, sums, mean, scatter about the mean) of the rows of ``x``; the sums are integers if ``x`` is."""
    mean = x.mean(axis=0)
    centred = x - mean
    return len(x), x.sum(axis=0), mean, centred.T @ centred


def merged(a: Stats | None, b: Stats | None) -> Stats | None:
    """The statistics of both tables together."""
    if a is None or b is None:
        return b if a is None else a
    n = a[0] + b[0]
    apart = b[2] - a[2]
    return n, a[1] + b[1], a[2] + apart * (b[0] / n), a[3] + b[3] + np.outer(apart, apart) * (a[0] * b[0] / n)


def table_statistics(vectors: DataFrame, project=None) -> Stats | None:
    """Statistics of column x of ``vectors``, after ``project`` if there is one; None of an empty table."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for b in batches:
            if b.num_rows:
                x = matrix(b, "x")
                found = merged(found, statistics_of(project(x) if project else x))
        if found:
            n, sums, mean, scatter = found
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [np.asarray(sums).tolist()], "mean": [mean.tolist()], "scatter": [scatter.ravel().tolist()]})

    kind = "double" if project else "long"
    parts = vectors.select("x").mapInArrow(local, f"n long, sums array<{kind}>, mean array<double>, scatter array<double>")

    def unpacked(row) -> Stats:
        d = len(row["mean"])
        return row["n"], np.array(row["sums"], float if project else np.int64), np.array(row["mean"]), np.array(row["scatter"]).reshape(d, d)

    found = parts.rdd.map(unpacked)
    depth = max(2, math.ceil(math.log(max(2, found.getNumPartitions()), FAN_IN)))
    return found.treeAggregate(None, merged, merged, depth)


def integer_rows(rows: DataFrame, vector: str) -> DataFrame:
    """(vec_id, x) of the rows that count, staged."""
    whole = stage(rows.select("vec_id", as_integers(F.col(vector)).alias("x")).where("x is not null"), "whole-vectors")
    lengths = whole.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(2).collect()
    return whole.where(F.size("x") == lengths[0]["d"]) if len(lengths) > 1 else whole


def eigen(stats: Stats, components: int = COMPONENTS) -> Whitening:
    n, sums, mean, scatter = stats
    values, axes = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, axes = values[::-1], axes[:, ::-1]
    total = max(float(values.sum()), 0.0)
    flat = values <= max(abs(values[0]), 1.0) * len(values) * np.finfo(float).eps
    values = np.where(flat, 0.0, values)[:components]
    axes = axes[:, :components] * np.sign(axes[np.argmax(np.abs(axes[:, :components]), axis=0), np.arange(min(components, len(axes)))])
    return Whitening(n, sums, mean, axes, values, values / total if total else np.zeros(len(values)))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits the whitening to the distinct vectors of column x (equally long integer lists); None if there are none."""
    once = stage(vectors.select("x").distinct(), "distinct-vectors")
    stats = table_statistics(once)
    if stats is None:
        return None
    model = eigen(stats, components)
    alive = model.eigenvalues > 0
    if not alive.any():
        return Whitening(**{**model.__dict__, "identity_error": 0.0})
    mean, scaled = model.mean, (model.axes * model.scales)[:, alive]
    n, _, _, scatter = table_statistics(once, lambda x: (x - mean) @ scaled)
    return Whitening(**{**model.__dict__, "identity_error": float(np.abs(scatter / n - np.eye(len(scatter))).max())})


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum over the dimensions of (n * x - S)^2, exact; raises if a row's is beyond 64 bits."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0))) * n + int(np.abs(sums).max(initial=0))
    if largest < 1 << 62:
        apart = x * np.int64(n) - sums
        if int(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return (apart * apart).sum(axis=1)
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    if max(exact, default=0) >= 1 << 63:
        raise OverflowError("a squared deviation does not fit into 64 bits")
    return np.array(exact, np.int64)


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) of every row that counts; both arrays go by component."""
    spark = rows.sparkSession
    id_type = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {id_type}, n long, deviation long, whitened array<double>"
    whole = integer_rows(rows, vector)
    model = fit(whole, components)
    if model is None:
        return spark.createDataFrame([], schema + ", explained array<double>, identity_error double")
    n, sums, mean, scaled, flat = model.n, model.sums, model.mean, model.axes * np.nan_to_num(model.scales), model.eigenvalues <= 0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b, "x")
            values = (x - mean) @ scaled
            listed = pa.array(values.ravel(), mask=np.broadcast_to(flat, values.shape).ravel())
            ends = pa.array(np.arange(0, listed.__len__() + 1, values.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(np.full(len(x), n)), pa.array(deviations(x, n, sums)), pa.ListArray.from_arrays(ends, listed)], names=["vec_id", "n", "deviation", "whitened"])

    explained = F.array(*[F.lit(float(v)) for v in model.explained])
    return whole.mapInArrow(project, schema).withColumn("explained", explained).withColumn("identity_error", F.lit(model.identity_error))


def query(spark, sf_dir: str) -> DataFrame:
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return out.select("vec_id", each, "n", "deviation", "identity_error").select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"
    )
