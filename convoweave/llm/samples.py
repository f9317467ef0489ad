"""Bounded samples of labelled rows to fit classifiers on, and the held-out rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for ids whose crc32 as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``per_class`` rows a class, none held out, each of at most ``max_bytes``.

    Rows are taken in the order of a hash of their id. Ids are chosen from the labels alone, so at most
    ``2 * per_class`` ids are broadcast and as many texts reach the driver. An id with several labels counts
    with the least; null ids and labels are left out; of rows that repeat an id one text is taken.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"))
    )
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.octet_length("text").between(1, max_bytes))
    rows = chosen.groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64)


def label_rate(labels: DataFrame, label: str) -> float:
    """Share of label 1 among the labels that are not held out; 0.5 if there are none."""
    row = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg(label)).first()
    return 0.5 if row[0] is None else float(row[0])


def blocks(batches: Iterable[pd.DataFrame], rows: int, size: int) -> Iterator[pd.DataFrame]:
    """Cuts Arrow batches into blocks of at most ``rows`` rows and about ``size`` characters of ``text``."""
    for batch in batches:
        batch["text"] = batch["text"].fillna("")
        start, total = 0, 0
        for i, n in enumerate(batch["text"].str.len()):
            if i > start and (i - start >= rows or total + n > size):
                yield batch.iloc[start:i]
                start, total = i, 0
            total += n
        if start < len(batch):
            yield batch.iloc[start:]
