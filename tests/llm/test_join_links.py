"""The n-gram join against brute force: components, numbers of links, large groups of near copies, split groups."""

import random
from collections import Counter

import numpy as np
import pytest

from convoweave.llm import ngram_join

WORDS = [f"w{k}" for k in range(400)]


def prose(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def shingles(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def expected(texts, n, percent):
    """(n_shingles, component, copies, links) of every text."""
    sets = [frozenset(shingles((t or "").lower().split(), n)) for t in texts]
    known: dict = {}
    rows = [[known.setdefault(x, len(known)) for x in s] for s in sets]
    grid = np.zeros((len(sets), len(known)), np.float32)
    for k, x in enumerate(rows):
        grid[k, x] = 1
    sizes = grid.sum(1)
    both = grid @ grid.T
    linked = (100 * both >= percent * (sizes[:, None] + sizes - both)) & (sizes[:, None] > 0) & (sizes > 0)
    np.fill_diagonal(linked, False)
    root = np.arange(len(sets))
    while True:
        new = np.minimum(root, np.where(linked, root, len(sets)).min(1))
        if (new == root).all():
            break
        root = new
    copies = Counter(s for s in sets if s)
    return [(len(s), int(root[k]), copies[s] if s else 1, int(linked[k].sum())) for k, s in enumerate(sets)]


def found(spark, texts, n, percent):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = ngram_join.join_components(df, n, percent).collect()
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_copies"], r["n_links"]) for r in rows}
    assert len(by_id) == len(rows) == len(texts)
    return [by_id[k] for k in range(len(texts))]


def families(seed, sizes, members, edits):
    r, out = random.Random(seed), []
    for size in sizes:
        base = prose(r, size)
        for _ in range(members):
            w = list(base)
            for _ in range(r.randrange(edits + 1)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            out.append(" ".join(w))
    r.shuffle(out)
    return [*out, None, "", "one", "ONE", "a b", *out[:40]]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("block", [2_000_000, 3_000])
def test_links_and_components(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    texts = families(n, [2, 4, 8, 16, 32, 33, 120, 500], 30, 6)
    assert found(spark, texts, n, percent) == expected(texts, n, percent)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_a_thousand_near_copies(spark, n, percent):
    texts = families(7, [150], 1000, 12) + families(8, [6000], 6, 100)
    assert found(spark, texts, n, percent) == expected(texts, n, percent)


def test_shuffle_joins_instead_of_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_VALUES", 0)
    texts = families(9, [20, 60], 25, 4)
    assert found(spark, texts, 3, 90) == expected(texts, 3, 90)


def test_keep_one_with_clashing_names_and_an_empty_table(spark):
    rows = [(k, "a b c d e f g h", 1, 2, 3) for k in (5, 3, None)] + [(3, "other words stand in this text", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key int, _id int, _least int")
    assert sorted(map(tuple, ngram_join.keep_one(docs).collect())) == [rows[1], rows[3]]
    assert ngram_join.keep_one(docs.where("false")).count() == 0


def test_join_equals_its_sql(spark, tmp_path):
    import duckdb

    texts = families(11, [2, 5, 40, 200], 12, 4) + [" \t ", "ÉTE éte", "A b c", "x y z\x0bw"]
    spark.createDataFrame([(k if k % 9 else 1000 + k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_links string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = ngram_join.query(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(f"SELECT {', '.join(got.columns)} FROM ({ngram_join.SQL})").fetchall())
