"""semantic_edges_docs_min against brute force."""

import itertools

from convoweave.plans import catalogue


def test_semantic_edges_docs_at_the_rules_own_threshold(spark, tmp_path):
    words = [[f"w{(7 * k + j * (1 + k % 3)) % 23}" for j in range(4 + k % 9)] for k in range(30)]
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["src"], r["dst"]): r["weight"] for r in catalogue.queries()["semantic_edges_docs_min"](spark, str(tmp_path)).collect()}
    sets = [set(w) for w in words]
    all_pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(range(30), 2)}
    assert got == {p: round(w, 6) for p, w in all_pairs.items() if w >= 0.3} and any(w < 0.6 for w in got.values())


def test_semantic_edges_docs_leaves_no_pair_of_the_rules_threshold_out(spark, tmp_path):
    texts = ["a b c d e", "a b c x y", "a b u v w", "p q", "p q r s t z"]  # 3 of 7, 2 of 8, 2 of 8; 2 of 6
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalogue.queries()["semantic_edges_docs"](spark, str(tmp_path)).select("src", "dst", "weight").collect())
    assert got == [(0, 1, 0.428571), (3, 4, 0.333333)]
