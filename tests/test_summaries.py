"""Summaries against a plain similarity graph, its random walk and a greedy choice."""

import math
import random
import re

import numpy as np
import pytest

from convoweave.operators import summaries as S


def split(text):
    return [(k, s.strip()) for k, s in enumerate(re.findall(r"[^.!?\n]+[.!?]*", text or "")) if len(words(s)) >= 4]


def words(s):
    return re.findall(r"[^\W_]+", s.lower())


def plain(rows, rounds, most_words, share=0.5):
    first = {}
    for conv, turn, text in sorted(rows, key=lambda r: r[:2]):
        for place, s in split(text):
            key = tuple(sorted(set(words(s))))
            first.setdefault(key, [(conv, turn, place), s, 0])[2] += 1
    keys = sorted(first, key=lambda k: first[k][0])
    n = len(keys)
    df = {w: sum(w in k for k in keys) for key in keys for w in key}
    b = [{w: math.log(1 + n / df[w]) for w in k} for k in keys]
    b = [{w: v / math.sqrt(sum(x * x for x in d.values())) for w, v in d.items()} for d in b]
    m = np.array([[0.0 if i == j else sum(v * b[j].get(w, 0) for w, v in b[i].items()) for j in range(n)] for i in range(n)])
    start = np.array([first[k][2] for k in keys]) / sum(f[2] for f in first.values())
    degree, rank = m.sum(1), start
    for _ in range(rounds):
        give = np.divide(rank, degree, out=np.zeros(n), where=degree > 1e-9)
        rank = (0.15 + 0.85 * rank[degree <= 1e-9].sum()) * start + 0.85 * (m.T @ give)
    taken, used = [], 0
    for i in sorted(range(n), key=lambda i: (-round(rank[i], 9), first[keys[i]][0])):
        s, k = first[keys[i]][1], set(keys[i])
        if used + len(s.split()) <= most_words and not any(len(k & set(keys[j])) >= share * len(k | set(keys[j])) for j in taken):
            taken.append(i)
            used += len(s.split())
    return {first[k][0]: r for k, r in zip(keys, rank, strict=True)}, " ".join(first[keys[i]][1] for i in sorted(taken)), used


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    vocabulary = ["deploy", "server", "index", "query", "cache", "index", "shard", "merge", "plan", "cost", "join", "sort", "café"]
    sentence = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randrange(3, 9))).capitalize() + r.choice(".!?")
    out = [(g, c, t, " ".join(sentence() for _ in range(r.randrange(5))) + ("\nThe cache of the shard is full.\nok." if c % 3 == 0 else "")) for g in "ab" for c in range(6) for t in range(3)]
    return [*out, ("c", 1, 0, None), ("c", 1, 1, "too short."), ("d", 1, 0, "Quite another matter here. Nothing alike can be found!"), ("d", 2, 0, "Quite another matter here.")]


@pytest.fixture(scope="module")
def found(spark, rows):
    return S.sentences(spark.createDataFrame(rows, "topic string, conv_id long, turn long, text string").repartition(3), "topic").cache()


def test_ranks_are_those_of_the_whole_graph(found, rows):
    got = {(r["topic"], r["conv_id"], r["turn"], r["place"]): r["rank"] for r in S.ranked(found, "topic", 6).collect()}
    want = {(g, *k): v for g in "abd" for k, v in plain([x[1:] for x in rows if x[0] == g], 6, 50)[0].items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    assert sum(v for k, v in got.items() if k[0] == "a") == pytest.approx(1)


def test_summaries(found, rows):
    got = {r["topic"]: r for r in S.summaries(found, "topic", 30, rounds=6).collect()}
    assert sorted(got) == ["a", "b", "d"]
    for g, r in got.items():
        _, text, used = plain([x[1:] for x in rows if x[0] == g], 6, 30)
        assert r["summary"] == text and r["n_words"] == used <= 30


def test_pages(spark, found):
    made = S.summaries(found.where("topic = 'd'"), "topic", rounds=2)
    lists = spark.createDataFrame([("d", 1, "action", 5, "call"), ("d", 1, "decision", 6, "go"), ("x", 1, "action", 1, "no")], "topic string, conv_id long, kind string, place long, item string")
    lines = [r["line"] for r in S.digest_lines(made, lists, "topic").orderBy("section", "place").collect()]
    assert lines == ["# d\n", "Quite another matter here. Nothing alike can be found!\n", "## Key Decisions\n", "- go", "## Action Items\n", "- [ ] call"]
    assert S.digest_lines(made, lists, "topic", actions=False, decisions=False).count() == 2
    assert S.summaries(found.limit(0), "topic", rounds=1).count() == 0


def test_groups_in_blocks_walk_alike(found, rows, monkeypatch):
    """Groups of more words than a task may hold are cut, and ranks stay those of the whole graph."""
    monkeypatch.setattr(S, "BLOCK", 60)
    got = {(r["topic"], r["conv_id"], r["turn"], r["place"]): r["rank"] for r in S.ranked(found, "topic", 4).collect()}
    want = {(g, *k): v for g in "abd" for k, v in plain([x[1:] for x in rows if x[0] == g], 4, 50)[0].items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_rounds_exchange_no_words(found, monkeypatch):
    """Ten rounds over small groups stage nothing: sentences and groups are all that is written."""
    staged, made = [], S.stage
    monkeypatch.setattr(S, "stage", lambda df, name: staged.append(name) or made(df, name))
    S.ranked(found, "topic", 10).collect()
    assert staged == ["sentences", "sentence-groups"]
