"""Toxicity: a linear-chain conditional random field that tags toxic spans.

Tokens are runs of characters other than white space. A token's features are its lower-cased form without outer
punctuation and that form's first 4 and 5 characters. Token labels come from document labels: in a bounded labelled
sample, freed of near copies, a feature that enough toxic documents have (``MIN_SUPPORT``, and a share of
``MIN_SHARE``) and almost no other marks its tokens, in toxic documents, as toxic. The field (two tags, transition and emission weights) is fitted to these sequences by
gradient ascent on the regularised conditional likelihood. Every whole text is then tagged: forward-backward gives
each token's marginal; the squares of all marginals combine to the document's score as one minus the product of their
complements, so that many faint ones do not make a long text toxic; neighbouring tokens of ``TAGGED`` or more form a
span, given by its character offsets. Long texts are tagged in overlapping pieces: a message forgets what lies
before it at a known rate, so with enough overlap the marginals are those of the whole text.

A text without tokens, or any text if no toxic row of the sample has tokens, scores 0. Other columns have no influence; rows
that repeat an id, or have none, are scored each by its text; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoweave.llm.samples import blocks, held_out, labelled_sample

PER_CLASS = 900
MAX_TRAIN_BYTES = 6_000
MIN_SUPPORT, MIN_SHARE = 3, 0.015
STEPS, RATE, PENALTY = 40, 0.3, 1e-3
TAGGED = 0.5
PIECE = 4_096
#: What a message at the start of an overlap may still change in log odds at its end.
FORGOTTEN = 1e-15
CACHED_WORDS = 300_000
BLOCK_CHARS = 4_000_000
OUTER = ".,;:!?'\"()[]{}*#$%&|<>-_"


def features(word: str) -> tuple[str, str, str]:
    w = word.lower().strip(OUTER)
    return w, w[:4] + "~", w[:5] + "~~"


def chain(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Position by position, the indices (into the concatenated tokens) of all sequences that are that long."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    for t, n in enumerate(alive):
        yield t, starts[:n] + t


def odds(x: np.ndarray, a: np.ndarray, turned: bool) -> np.ndarray:
    """log of (toxic : other) after one transition from log odds ``x``; ``turned``: against the chain's direction."""
    e = np.exp(np.clip(x, -30, 30))
    return np.log((a[1, 0] + a[1, 1] * e) / (a[0, 0] + a[0, 1] * e)) if turned else np.log((a[0, 1] + a[1, 1] * e) / (a[0, 0] + a[1, 0] * e))


def forward_backward(emission: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the forward messages (with the token's own emission) and of the backward ones, for all sequences at once."""
    f, b = np.empty_like(emission), np.zeros_like(emission)
    steps = [at for _, at in chain(lengths)]
    for t, at in enumerate(steps):
        f[at] = emission[at] + (odds(f[at - 1], a, False) if t else 0.0)
    for t in range(len(steps) - 1, 0, -1):
        at = steps[t]
        b[at - 1] = odds(emission[at] + b[at], a, True)
    return f, b


def overlap(a: np.ndarray) -> int:
    """Tokens after which two messages differ by less than ``FORGOTTEN``: a transition shrinks their gap by a fixed factor."""
    factor = np.tanh(abs(math.log(a[0, 0] * a[1, 1] / (a[0, 1] * a[1, 0]))) / 4)
    return 1 if factor < FORGOTTEN else math.ceil(math.log(FORGOTTEN / 60) / math.log(min(factor, 1 - 1e-9)))


def marginals(emission: np.ndarray, lengths: np.ndarray, a: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """The chance that a token is toxic, for all tokens of all sequences; sequences of over ``piece`` tokens are cut."""
    lead = overlap(a)
    piece = max(piece, 4 * lead)
    counts = np.maximum(1, -(-lengths // piece))
    first = np.repeat(np.cumsum(lengths) - lengths, counts)
    last = np.repeat(np.cumsum(lengths), counts)
    start = first + piece * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    end = np.minimum(start + piece, last)
    left, right = np.maximum(start - lead, first), np.minimum(end + lead, last)
    sizes = right - left
    at = np.repeat(left - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    f, b = forward_backward(emission[at], sizes, a)
    own = (at >= np.repeat(start, sizes)) & (at < np.repeat(end, sizes))
    return sigmoid((f + b)[own])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def distinct_texts(texts: list[str], y: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Drops texts that share one of four least shingle hashes with an earlier one (near copies)."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for i, text in enumerate(texts):
        w = text.split()
        h = np.array([zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))], np.uint64)
        marks = {(k, int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((1, 2654435761, 2246822519, 3266489917))}
        if not marks & seen:
            keep.append(i)
        seen |= marks
    return [texts[i] for i in keep], y[keep]


def fit(texts: list[str], y: np.ndarray) -> tuple[dict[str, float], float, np.ndarray]:
    """Feature weights (those that differ from 0), bias and transition weights of the field."""
    texts, y = distinct_texts(texts, y)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.split()], np.int64) for t in texts]
    names: dict[str, int] = {}
    table = np.array([[names.setdefault(f, len(names)) for f in features(w)] for w in vocabulary], np.int64)
    size = len(names)
    with_, without = np.zeros(size), np.zeros(size)
    for tokens, label in zip(docs, y, strict=True):
        (with_ if label else without)[np.unique(table[tokens])] += 1
    telling = (with_ >= max(MIN_SUPPORT, MIN_SHARE * y.sum())) & (with_ / max(1, y.sum()) > 50 * without / max(1, (1 - y).sum()))
    marked = telling[table].any(1)
    lengths = np.array([len(d) for d in docs])
    tokens = np.concatenate(docs)
    tags = marked[tokens] & np.repeat(y == 1, lengths)
    inner = np.ones(len(tokens), bool)  # tokens with one before them in their text
    inner[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    second = np.flatnonzero(inner)
    weights, bias, trans = np.zeros(size), -4.0, np.zeros((2, 2))
    moments = [np.zeros(size), 0.0, np.zeros((2, 2))], [np.zeros(size), 0.0, np.zeros((2, 2))]
    counted = np.array([[np.sum((tags[second - 1] == i) & (tags[second] == j)) for j in (0, 1)] for i in (0, 1)], float)
    n = max(1, int(tags.sum()))
    for step in range(1, STEPS + 1):
        emission = (weights[table].sum(1) + bias)[tokens]
        a = np.exp(trans)
        f, b = forward_backward(emission, lengths, a)
        gap = tags - sigmoid(f + b)
        by_word = np.bincount(tokens, gap, len(table))
        left, right = np.exp(np.clip(f[second - 1], -30, 30)), np.exp(np.clip(emission[second] + b[second], -30, 30))
        joint = np.stack([np.full(len(second), a[0, 0]), a[0, 1] * right, a[1, 0] * left, a[1, 1] * left * right])
        expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        gradient = [np.bincount(table.ravel(), np.repeat(by_word, table.shape[1]), size) / n - PENALTY * weights, gap.sum() / n, (counted - expected) / n - PENALTY * trans]
        values = [weights, bias, trans]
        for k, g in enumerate(gradient):  # Adam
            moments[0][k] = 0.9 * moments[0][k] + 0.1 * g
            moments[1][k] = 0.99 * moments[1][k] + 0.01 * g * g
            values[k] = values[k] + RATE * (moments[0][k] / (1 - 0.9**step)) / (np.sqrt(moments[1][k] / (1 - 0.99**step)) + 1e-6)
        weights, bias, trans = values
    return {f: float(weights[k]) for f, k in names.items() if abs(weights[k]) > 1e-3}, float(bias), trans


class Emissions(dict):
    """word -> emission, emptied when full."""

    def __init__(self, weights: dict[str, float], bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        return out


def spans(text: str, marginals: np.ndarray) -> list[dict]:
    """Character offsets of runs of tagged tokens."""
    out: list[dict] = []
    before = -2
    for k, m in enumerate(re.finditer(r"\S+", text)):
        if k >= len(marginals):
            break
        if marginals[k] >= TAGGED:
            if before == k - 1 and out:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            before = k
    return out


def tag(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, spans of every row."""
    texts, y = labelled_sample(docs, labels, label, PER_CLASS, MAX_TRAIN_BYTES)
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, y) if any(t.split() for t, label in zip(texts, y, strict=True) if label) else None)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Emissions(*model.value[:2]) if model.value else None
        for block in blocks(batches, 10_000, BLOCK_CHARS):
            texts = block["text"].tolist()
            scores, found = np.zeros(len(texts)), [[] for _ in texts]
            if known is not None:
                split = [t.split() for t in texts]
                lengths = np.array([len(s) for s in split])
                emission = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(split)), float, lengths.sum())
                of = np.repeat(np.arange(len(texts)), lengths)
                p = marginals(emission, lengths, np.exp(model.value[2]))
                scores = 1 - np.exp(np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12) ** 2), len(texts)))
                starts = np.cumsum(lengths) - lengths
                for i in np.unique(of[np.flatnonzero(p >= TAGGED)]):
                    found[i] = spans(texts[i], p[starts[i] : starts[i] + lengths[i]])
            yield pd.DataFrame({"doc_id": block["doc_id"].astype("Int64"), "score": np.round(scores, 12), "spans": found})

    out = docs.select("doc_id", "text").mapInPandas(score, "doc_id long, score double, spans array<struct<start:int,end:int>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def query(spark, sf_dir: str) -> DataFrame:
    out = tag(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"), "spans")
