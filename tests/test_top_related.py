"""The best two-hop links through bounded strides against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from convoweave.operators import linking as L


def frames(spark, edges, terms):
    return spark.createDataFrame(edges, "src long, dst long, weight double, relationship string"), spark.createDataFrame(terms, "id long, term string, weight double").repartition(3)


def random_graph(seed, n, common, levels):
    """Conversations of a few rare terms and some that nearly all have, with weights of few or many levels."""
    r = random.Random(seed)
    terms = {(k, f"rare{r.randrange(n)}"): r.choice(levels) for k in range(n) for _ in range(r.randrange(3))}
    terms |= {(k, f"common{c}"): r.choice(levels) for k in range(n) for c in range(common) if r.random() < 0.8}
    edges = {(min(p), max(p)): r.choice((0.1, 0.3, 1.5)) for p in (r.sample(range(n), 2) for _ in range(n))}
    return [(a, b, w, "shared_tags") for (a, b), w in edges.items()], [(k, t, w) for (k, t), w in terms.items()]


@pytest.mark.parametrize(("seed", "common", "levels"), [(1, 1, (1.0,)), (2, 3, (0.25, 0.5, 1.0)), (3, 2, tuple(k / 97 for k in range(1, 97)))])
def test_equals_all_pairs(spark, seed, common, levels):
    edges, terms = frames(spark, *random_graph(seed, 150, common, levels))
    want = L.related(L.candidates(edges, terms), 5)
    got = L.top_related(edges, terms, 5, common=8)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("weight", ["1.0", "(id * 37 % 101 + 1) / 101.0"])
def test_a_term_in_every_conversation_is_linear(spark, monkeypatch, weight):
    made = []
    scores = L.common_scores
    monkeypatch.setattr(L, "common_scores", lambda pairs, often: made.append(pairs.count()) or scores(pairs, often))
    n = 3000
    terms = spark.range(n).select("id", F.lit("everywhere").alias("term"), F.expr(weight).cast("double").alias("weight"))
    edges = spark.createDataFrame([], "src long, dst long, weight double, relationship string")
    got = L.top_related(edges, terms, least=0.0)
    rows = got.groupBy("src").agg(F.count("*").alias("n")).groupBy("n").count().collect()
    assert [tuple(r) for r in rows] == [(10, n)] and sum(made) <= 2 * L.BLOCK * n
    heavy = sorted(((w, i) for i, w in ((r["id"], r["weight"]) for r in terms.collect())), key=lambda x: (-x[0], x[1]))
    want = [i for _, i in heavy[:11] if i != 7][:10]
    assert [r["dst"] for r in got.where("src = 7").orderBy("rank").collect()] == want


def test_empty(spark):
    edges, terms = frames(spark, [], [])
    assert L.top_related(edges, terms).count() == 0
    edges, terms = frames(spark, [(1, 2, 0.5, "x"), (1, 3, 0.2, "x")], [])
    assert [tuple(r) for r in L.top_related(edges, terms).orderBy("src").collect()] == [(1, 2, 0.5, "x", 1), (2, 1, 0.5, "x", 1)]
