"""The convergent PageRank against power iteration by numpy."""

import numpy as np

from convoweave.operators import graph
from convoweave.plans import catalogue


def test_pagerank_converges(spark, tmp_path):
    text = lambda k: f"alpha{k % 3:03d}" .replace("0", "o").replace("1", "i").replace("2", "z") + " shared common" * (k % 2)
    spark.createDataFrame([(k, 0, "user", text(k)) for k in range(12)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["id"]: r["rank"] for r in catalogue.queries()["pagerank"](spark, str(tmp_path)).collect()}
    m = np.zeros((12, 12))
    for e in catalogue.edges(spark, str(tmp_path)).collect():
        m[e["src"], e["dst"]] = m[e["dst"], e["src"]] = e["weight"]
    total, rank = m.sum(1), np.full(12, 1 / 12)
    for _ in range(500):
        share = np.divide(rank, total, out=np.zeros(12), where=total > 0)
        rank = 0.15 / 12 + 0.85 * (m.T @ share + rank[total == 0].sum() / 12)
    assert max(abs(got[k] - rank[k]) for k in range(12)) < 12 * 1e-5 and abs(sum(got.values()) - 1) < 1e-6


def test_many_terms_leave_the_ranks_of_pairs_broadcast(spark, monkeypatch):
    """Nodes beyond the limit, most of them ends of few links: pairs meet broadcast ranks, and the result is that of one graph."""
    nodes = spark.range(60)
    pairs = spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a in range(8) for b in range(a + 1, 8) if (a * b) % 3], "src long, dst long, weight double")
    links = spark.createDataFrame([(k % 9, k, 1.0) for k in range(10, 50)], "src long, dst long, weight double")
    want = {r["id"]: r["rank"] for r in graph.pagerank(nodes, pairs.unionByName(links), 4, tolerance=None).collect()}
    plans, made = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or made(df, name))
    monkeypatch.setattr(graph, "BROADCAST_NODES", 10)
    got = {r["id"]: r["rank"] for r in graph.pagerank(nodes, pairs, 4, tolerance=None, links=links).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len(plans) == 5 and all(p.count("strategy=broadcast") >= 3 for p in plans[1:])  # two for the pairs, one for the lost sum
