"""The pipeline: each stage and the whole run against brute force on a fixture with nulls, repeats and clashing names."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from convoweave.llm import quality_neighbours
from test_join_links import expected

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted", "held_out", "_key", "_null", "bad_id", "_size", "_copy", "_ordinal", "key", "copies"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES[5:])


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice([f"w{k}" for k in range(400)]) for _ in range(n))


def bad(text):
    return " ".join(w.upper() + "!!" for w in text.split())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    item = prose(900, 30)
    texts = [bad(prose(k, 40)) if k % 4 == 0 else prose(k, 40 + k % 9) for k in range(160)]
    near = texts[1].split()
    near[3] = "changed"
    texts += [texts[1], " ".join(near), prose(500, 30) + " " + item + " " + prose(501, 20), item, None, "", "one two", texts[2]]
    ids = [*range(160), 160, 161, 162, 163, 164, 165, 166, None]
    rows = [(i, t, "en", ("a", "b", "c", None)[k % 4], 0, *["x"] * 11) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [(7, texts[9], "en", "a", 0, *["y"] * 11), (7, texts[7], "en", "d", 0, *["y"] * 11), (5, texts[5], "en", "a", 0, *["x"] * 11)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality_keeps_what_is_predicted_good(spark, docs, folder):
    kept = corpus_pipeline.keep_good(spark, docs, folder)
    assert kept.columns == NAMES
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality_neighbours.score_quality(docs.select("doc_id", "text"), labels).collect()
    good = Counter((r["doc_id"], r["text"]) for r in scored if r["predicted"])
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == good
    assert all((r["doc_id"], r["text"]) in good for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 160 and r["doc_id"] % 4)
    assert not any(i is not None and i < 160 and i % 4 == 0 for i, t in good if t and "!!" in t)
    assert {r for r in rows_of(kept)} <= {r for r in rows_of(docs)}


def test_votes_equal_a_plain_search(spark, folder, docs):
    import numpy as np

    rows = [r for r in docs.select("doc_id", "text").collect() if r["text"]]
    texts, y = [r["text"] for r in rows[:60]], np.arange(60) % 2
    axes, known, votes = quality_neighbours.fit(texts, y)
    vectors = quality_neighbours.unit(quality_neighbours.term_shares([r["text"] for r in rows], quality_neighbours.WordCodes()) @ axes)
    got = quality_neighbours.vote(vectors, known, votes, 0.5)
    for v, g in zip(vectors.astype(float), got, strict=True):
        near = sorted(((float(v @ k.astype(float)), int(label)) for k, label in zip(known, votes, strict=True)), reverse=True)[: quality_neighbours.NEIGHBOURS]
        weight = [max(c, 0) ** quality_neighbours.SHARPNESS for c, _ in near]
        want = sum(w * label for w, (_, label) in zip(weight, near, strict=True)) / sum(weight) if sum(weight) > 1e-9 else 0.5
        assert abs(want - g) < 2e-2  # float32 against float64, ties


def test_near_duplicates_leave_one_of_each_component(spark, docs, folder):
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder)
    assert kept.columns == NAMES
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    groups = {}
    for r, (n, root, _, _) in zip(rows, expected([r["text"] for r in rows], 5, 80), strict=True):
        groups.setdefault(root if n else ("no words", id(r)), []).append(r)
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert sum(got.values()) == len(groups)
    for members in groups.values():
        least = min((r["doc_id"] is None, r["doc_id"]) if r["doc_id"] is not None else (True, 0) for r in members)
        assert any((r["doc_id"], r["text"]) in got and ((r["doc_id"] is None, r["doc_id"]) if r["doc_id"] is not None else (True, 0)) == least for r in members)


def shingles(text):
    w = [x.lower() for x in re.split(r"[\W_]+", text or "") if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_benchmark_items_go(spark, docs, folder):
    kept = corpus_pipeline.drop_benchmark(spark, docs, folder)
    item = shingles(prose(900, 30))
    want = [tuple(r) for r in docs.collect() if 100 * len(item & shingles(r["text"])) < 80 * len(item)]
    assert rows_of(kept) == sorted(want, key=repr) and kept.count() == docs.count() - 2


def test_mix_takes_words_near_the_targets(spark, docs, folder):
    taken = corpus_pipeline.mix_sources(spark, docs, folder)
    assert taken.columns == NAMES and rows_of(taken) == rows_of(corpus_pipeline.mix_sources(spark, docs, folder))
    size = lambda r: len((r["text"] or "").split())
    had, got = Counter(tuple(r) for r in docs.collect()), Counter(tuple(r) for r in taken.collect())
    assert all(got[r] <= 2 * had[r] for r in got)
    sources = sorted({r["source"] for r in docs.collect()}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(r) for r in docs.collect() if r["source"] == s) for s in sources}
    target, free, total = {}, list(sources), 1.5 * sum(sizes.values())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free = [s for s in free if s not in over]
    for s in sources:
        most = max(size(r) for r in docs.collect() if r["source"] == s)
        assert abs(sum(size(r) for r in taken.collect() if r["source"] == s) - target[s]) <= most


def test_run_is_its_stages(spark, folder, docs):
    found = corpus_pipeline.run(spark, folder)
    at = docs
    for _, f in corpus_pipeline.STAGES:
        at = f(spark, at, folder)
    assert rows_of(found) == rows_of(at) and found.count() > 100
    by_shard = {}
    for r in found.collect():
        by_shard.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert all(sorted(s for s, _ in part) == list(range(len(part))) for part in by_shard.values())
    total = [sum(n for _, n in part) for part in by_shard.values()]
    most = 2 * max(n for part in by_shard.values() for _, n in part)  # both copies of a text stay together
    assert len(total) == 16 and all(abs(n - sum(total) / 16) <= most for n in total)


def test_stages_of_nothing(spark, docs, folder):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.where("false"), folder).count() == 0, name
