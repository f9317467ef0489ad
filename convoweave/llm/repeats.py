"""Exact-substring deduplication: bytes covered by a string of ``LENGTH`` bytes that starts elsewhere too.

Every text is its UTF-8 bytes (null: none); matches never cross texts. The work is exchanged by content anchors:

1. Texts are gathered by a 64-bit hash into a bucketed table, once each with the number of copies.
2. In every window of ``LENGTH`` bytes the ``GRAM``-byte string of least hash is its anchor, so equal windows have equal
   anchors at equal places. Anchors seen once need no further look.
3. Each repeated anchor sends its surroundings (the bytes of all windows that contain it) to the anchor's hash. Equal
   surroundings meet as neighbours and are collapsed to one as they stream by, so a hot passage takes little memory. Then
   windows are ordered by their content, and neighbours in that order that are equal are repeats: the previous one in
   order of position is an earlier match, the next a later one.
4. The repeats go back to their text as byte ranges and are merged.

``keep="none"`` removes all copies, ``keep="first"`` all but the first by (text hash, position). Windows are told apart
by 64-bit hashes. Texts shorter than ``LENGTH`` are kept. Rows that repeat an id are rows of their own; a row whose
whole text occurs again is removed if it is long enough. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoweave.llm.samples import blocks
from convoweave.llm.shingles import mix, powers
from convoweave.shared import stage, staging_path

LENGTH, GRAM = 200, 128
SPREAD = LENGTH - GRAM
BLOCK_CHARS = 1_000_000
BLOCK_CONTEXTS = 4_000


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with ``LENGTH`` zero bytes around each; starts and ends."""
    gap = bytes(LENGTH)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = LENGTH + np.cumsum(sizes + LENGTH) - sizes - LENGTH
    return np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8), starts, starts + sizes


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(1 << max(16, int(data.shape[-1]).bit_length()))
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: data.shape[-1]], axis=-1)
    return np.concatenate([np.zeros((*data.shape[:-1], 1), np.uint64), sums], axis=-1), down


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, in linear time."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of every anchor."""
    data, starts, ends = joined(texts)
    sums, down = prefix_sums(data)
    n = len(data) - GRAM + 1
    h = mix((sums[GRAM:] - sums[:-GRAM]) * down[:n])
    bits = np.uint64(32)  # the same for all blocks: what wins in a window depends on the window alone; ties go to the left
    least = sliding_min((h >> bits << bits) | np.arange(n, dtype=np.uint64), SPREAD + 1)
    marks = np.zeros(len(data) + 1, np.int8)
    long = ends - starts >= LENGTH
    np.add.at(marks, starts[long], 1)
    np.add.at(marks, ends[long] - LENGTH + 1, -1)
    at = np.unique(least[np.cumsum(marks[: len(least)]) > 0] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.searchsorted(starts, at, side="right") - 1
    return doc, at - starts[doc], h[at].view(np.int64)


def distinct_texts(docs: DataFrame, name: str) -> DataFrame:
    """tid, text, copies in a table bucketed by tid in the shared folder; copies are combined before the exchange."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(F.xxhash64("text").alias("tid"), "text")
    (
        texts.groupBy("tid").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        .write.format("parquet").option("compression", "zstd").option("path", staging_path(spark, "texts")).bucketBy(buckets, "tid").saveAsTable(name)
    )
    return spark.table(name)


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """tid and the list of its (pos, h) whose hash occurs again. Rows stream by in hash order; none is held back."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks(batches, 5_000, BLOCK_CHARS):
            doc, pos, h = anchors([t.encode() for t in b["text"]])
            yield pd.DataFrame({"h": h, "tid": b["tid"].to_numpy()[doc], "pos": pos})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in itertools.chain(batches, [None]):
            if b is None:
                return
            b = b if last is None else pd.concat([last, b], ignore_index=True)
            same = b["h"].to_numpy()[1:] == b["h"].to_numpy()[:-1]
            told = b["told"].to_numpy()
            twice = np.r_[False, same] | np.r_[same, False]
            yield b.loc[twice & ~told, ["tid", "pos", "h"]]
            last = b.iloc[-1:].assign(told=bool(twice[-1]) or bool(told[-1]))

    found = texts.select("tid", "text").mapInPandas(find, "h long, tid long, pos long").withColumn("told", F.lit(False))
    twice = found.repartition("h").sortWithinPartitions("h").mapInPandas(again, "tid long, pos long, h long")
    return twice.groupBy("tid").agg(F.collect_list(F.struct("pos", "h")).alias("marks"))


def surroundings(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """h, tid, pos, size, context of every repeated anchor."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks(batches, 2_000, BLOCK_CHARS):
            data, starts, ends = joined([t.encode() for t in b["text"]])
            doc = np.repeat(np.arange(len(b)), [len(m) for m in b["marks"]])
            pos = np.array([m["pos"] for ms in b["marks"] for m in ms], np.int64)
            h = np.array([m["h"] for ms in b["marks"] for m in ms], np.int64)
            raw, width = data.tobytes(), LENGTH + SPREAD
            for i in range(0, len(pos), BLOCK_CONTEXTS):
                part = slice(i, i + BLOCK_CONTEXTS)
                first = starts[doc[part]] + pos[part] - SPREAD
                yield pd.DataFrame({"h": h[part], "tid": b["tid"].to_numpy()[doc[part]], "pos": pos[part], "size": (ends - starts)[doc[part]], "context": [raw[k : k + width] for k in first]})

    both = texts.select("tid", "text").join(marks.hint("shuffle_hash"), "tid")
    return both.mapInPandas(cut, "h long, tid long, pos long, size long, context binary")


def repeats_in(h: np.ndarray, tid: np.ndarray, pos: np.ndarray, size: np.ndarray, context: list[bytes], first_kept: bool) -> pd.DataFrame:
    """Byte ranges (tid, low, high) of repeated windows among surroundings that hold whole anchor groups."""
    data = np.frombuffer(b"".join(context), np.uint8).reshape(len(context), LENGTH + SPREAD)
    sums, down = prefix_sums(data)
    window = (sums[:, LENGTH:] - sums[:, :-LENGTH]) * down[: SPREAD + 1]
    offset = np.arange(SPREAD + 1)
    start = pos[:, None] - SPREAD + offset
    valid = (start >= 0) & (start + LENGTH <= size[:, None])
    key = mix(window + mix(h.view(np.uint64))[:, None] + (offset.astype(np.uint64) << np.uint64(32)))[valid]
    row = np.nonzero(valid)[0]
    order = np.lexsort((pos[row], tid[row], key)) if first_kept else np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    repeated = np.zeros(len(key), bool)
    repeated[order[1:][same]] = True  # has an earlier match
    if not first_kept:
        repeated[order[:-1][same]] = True  # has a later one
    flags = np.zeros((len(context), SPREAD + 3), np.int8)
    flags[:, 1:-1][valid] = repeated
    steps = np.diff(flags, axis=1)
    r, a = np.nonzero(steps == 1)
    _, z = np.nonzero(steps == -1)
    return pd.DataFrame({"tid": tid[r], "low": pos[r] - SPREAD + a, "high": pos[r] - SPREAD + z - 1 + LENGTH})


def repeated_ranges(contexts: DataFrame, first_kept: bool) -> DataFrame:
    def identical(rows: pd.DataFrame) -> np.ndarray:
        """Whether each row has the surroundings of the row before it."""
        c, h, left, right = (rows[x].to_numpy() for x in ("context", "h", "left", "right"))
        return np.r_[False, (h[1:] == h[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1]) & (c[1:] == c[:-1])]

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        """All windows around these anchors."""
        return pd.DataFrame({"tid": rows["tid"], "low": np.maximum(0, rows["pos"] - SPREAD), "high": np.minimum(rows["pos"], rows["size"] - LENGTH) + LENGTH})

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, last = None, None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                # Anchors with equal surroundings repeat each other entirely; one of them stands for all in what follows.
                rows = b if last is None else pd.concat([last, b], ignore_index=True)
                same, old = identical(rows), int(last is not None)
                last = rows.iloc[-1:]
                again = same | (np.r_[same[1:], False] if not first_kept else False)
                yield whole(rows[again])
                rows = rows[~same].iloc[old:] if old else rows[~same]
                rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
                h = rows["h"].to_numpy()
                done = int(np.searchsorted(h, h[-1])) if len(h) else 0
                rows, rest = rows.iloc[:done], rows.iloc[done:]
            elif rest is None:
                return
            else:
                rows = rest
            h = rows["h"].to_numpy()
            i = 0
            while i < len(h):  # whole groups, about BLOCK_CONTEXTS rows at a time
                j = int(np.searchsorted(h, h[min(i + BLOCK_CONTEXTS, len(h)) - 1], side="right"))
                yield repeats_in(h[i:j], *(rows[c].to_numpy()[i:j] for c in ("tid", "pos", "size")), rows["context"].tolist()[i:j], first_kept)
                i = j

    sides = contexts.withColumn("left", F.least("pos", F.lit(SPREAD))).withColumn("right", F.least(F.col("size") - F.col("pos"), F.lit(LENGTH)))
    dealt = sides.repartition("h").sortWithinPartitions("h", "context", "left", "right", "tid", "pos")
    return dealt.mapInPandas(search, "tid long, low long, high long")


def merged(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(low, high, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, keep: str = "none") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row; spans are byte ranges."""
    spark, name = docs.sparkSession, f"repeats_{uuid.uuid4().hex}"
    texts = distinct_texts(docs, name)
    marks = stage(repeated_anchors(texts), "repeats-anchors")
    ranges = stage(repeated_ranges(surroundings(texts, marks), keep == "first"), "repeats-ranges")
    per_text = ranges.distinct().groupBy("tid").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks(batches, 2_000, 4 * BLOCK_CHARS):
            out = []
            for tid, text, copies, found in zip(b["tid"], b["text"], b["copies"], b["ranges"], strict=True):
                data = text.encode()
                if copies > 1 and len(data) >= LENGTH and keep == "none":
                    spans = [(0, len(data))]
                else:
                    spans = merged([x["low"] for x in found], [x["high"] for x in found]) if found is not None else []
                kept, at = hashlib.sha256(), 0
                for low, high in spans:
                    kept.update(data[at:low])
                    at = high
                kept.update(data[at:])
                out.append((tid, len(data), sum(y - x for x, y in spans), len(spans), kept.hexdigest(), [{"start": x, "end": y} for x, y in spans]))
            yield pd.DataFrame(out, columns=["tid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    judged = texts.join(per_text.hint("shuffle_hash"), "tid", "left").mapInPandas(
        judge, "tid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    )
    ids = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid"))
    judged = stage(judged, "repeats-judged")
    spark.sql(f"DROP TABLE {name}")  # the entry in the catalogue; its files go with the other staged tables
    return ids.join(judged, "tid").drop("tid")


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
