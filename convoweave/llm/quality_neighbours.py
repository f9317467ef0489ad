"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A document's terms are the shapes of its words (runs of one kind of character collapsed to one sign), pairs of
neighbouring shapes, hashes of its words, and a mark for a word that equals the one before. Square roots of
term shares times inverse document frequencies are projected to ``DIMENSIONS`` latent axes, from a truncated singular
value decomposition of the labelled sample, and scaled to length 1. The sample's vectors (at most ``2 * PER_CLASS``
times ``DIMENSIONS`` numbers, under 1 MB) are broadcast; every document is held against all of them in blocks of
exact cosine products, and the labels of the ``NEIGHBOURS`` nearest are averaged, weighted by a power of the cosine.

Every whole text is scored. Texts without words, and any text if there are no labels, get the rate of label 1 (0.5
without labels). The score does not depend on other columns; rows that repeat an id are scored each by its text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoweave.llm.samples import blocks, held_out, label_rate, labelled_sample
from convoweave.llm.text import free_names

PER_CLASS = 1500
MAX_TRAIN_BYTES = 20_000
DIMENSIONS = 32
NEIGHBOURS = 15
SHARPNESS = 6
THRESHOLD = 0.3
SHAPES, PAIRS, WORDS = 256, 512, 1024
TERMS = SHAPES + PAIRS + WORDS + 1
CACHED_WORDS = 300_000


def shape(word: str) -> str:
    out = []
    for ch in word:
        kind = "x" if ch.islower() else "X" if ch.isupper() else "d" if ch.isdigit() else ch
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class WordCodes(dict):
    """word -> hash << 20 | shape << 11 | term of the word (0 for punctuation), emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        plain = word.strip(".,;:!?'\"()").lower()
        term = 1 + zlib.crc32(plain.encode()) % (WORDS - 1) if plain else 0
        code = zlib.crc32(word.encode()) << 20 | zlib.crc32(shape(word).encode()) % SHAPES << 11 | term
        self[word] = code
        return code


def term_shares(texts: list[str], codes: WordCodes) -> np.ndarray:
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        v = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        s, w = v >> 11 & (SHAPES - 1), v & (WORDS - 1)
        pairs = SHAPES + (s[:-1] * 31 + s[1:]) % PAIRS
        counts = np.bincount(np.concatenate([s, pairs, w[w > 0] + (SHAPES + PAIRS)]), minlength=TERMS)
        counts[-1] = np.count_nonzero(v[1:] == v[:-1])
        out[i] = np.sqrt(counts / len(words))
    return out


def latent_axes(x: np.ndarray, dimensions: int) -> np.ndarray:
    """Right singular vectors by subspace iteration with a fixed start."""
    rng = np.random.default_rng(7)
    q = np.linalg.qr(x.T @ rng.standard_normal((len(x), min(dimensions + 8, *x.shape))))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :dimensions].astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(projection with the idf in it, unit vectors, labels) of the labelled sample."""
    x = term_shares(texts, WordCodes())
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    axes = latent_axes(x * idf, DIMENSIONS) * idf[:, None]
    return axes, unit(x @ axes), y


def vote(vectors: np.ndarray, known: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
    cosines = vectors @ known.T
    k = min(NEIGHBOURS, len(y))
    top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosines, top, 1), 0) ** SHARPNESS
    total = weight.sum(1)
    return np.where(total > 1e-9, (weight * y[top]).sum(1) / np.maximum(total, 1e-9), rate)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and held_out, score, predicted; these names replace columns of the input."""
    texts, y = labelled_sample(docs, labels, label, PER_CLASS, MAX_TRAIN_BYTES)
    rate = label_rate(labels, label)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, y) if len(y) else None)
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    schema = docs.select(*names).withColumn("score", F.lit(0.0)).schema

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for b in blocks(batches, 256, 4_000_000):
            if model.value is None:
                yield b.assign(score=rate)
                continue
            axes, known, votes = model.value
            x = term_shares(b["text"].tolist(), codes)
            yield b.assign(score=np.where(x.any(1), vote(unit(x @ axes), known, votes, rate), rate).astype(float).round(9))

    (no_text,) = free_names(docs, "null")
    null_text = docs.select(*names).withColumn(no_text, F.col("text").isNull())
    schema = schema.add(no_text, "boolean")
    out = null_text.mapInPandas(lambda it: (b[[f.name for f in schema]] for b in score(it)), schema)
    out = out.withColumn("text", F.when(~F.col(no_text), F.col("text"))).drop(no_text)
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are predicted to be good, with all columns of ``docs`` as they are, whatever their names."""
    outer = free_names(docs, *[f"{i}" for i in range(len(docs.columns))])
    others = [(c, o) for c, o in zip(docs.columns, outer, strict=True) if c not in ("doc_id", "text")]
    renamed = docs.select("doc_id", "text", *[docs[c].alias(o) for c, o in others])
    good = score_quality(renamed, labels, label, threshold).where("predicted = 1")
    back = dict(others)
    return good.select(*[F.col(back.get(c, c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")
