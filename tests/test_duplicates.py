"""Near duplicates against a plain greedy pass over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from convoweave.operators import duplicates as D


def greedy(sets, threshold):
    out, kept = {}, []
    for k in sorted(sets):
        s = sets[k]
        alike = [(j, len(s & sets[j]) / len(s | sets[j])) for j in kept if s and sets[j] and len(s & sets[j]) >= threshold * len(s | sets[j])]
        out[k] = (*alike[0][:1], round(alike[0][1], 6)) if alike else (k, 1.0)
        kept += [] if alike else [k]
    return out


@pytest.fixture(scope="module")
def sets():
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(500)]
    out, k = {}, 0
    for family in range(25):
        base = set(r.sample(vocabulary, 60))
        for _ in range(1 + family % 5 * 2):
            changed = r.randrange(9)
            out[k] = set(sorted(base)[changed:]) | {f"x{k}-{j}" for j in range(r.randrange(4))}
            k += 1
    common = set(r.sample(vocabulary, 80))
    out |= {1000 + j: common | {f"y{j % 7}"} for j in range(120)}  # one large family
    return out | {2000: set(), 2001: set(), 2002: {"one"}, 2003: {"one"}}


@pytest.fixture(scope="module")
def words(spark, sets):
    rows = [(k, w) for k, s in sets.items() for w in (s or {None})]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows + rows[:50], "id long, word string").repartition(5)


def test_exact(words, sets):
    got = D.exact_duplicates(words).collect()
    assert {r["id"]: (r["keep_id"], r["similarity"]) for r in got} == greedy(sets, 0.85) and len(got) == len(sets)
    assert all(r["kept"] == (r["id"] == r["keep_id"]) for r in got)


def test_bands_find_what_is_there(words, sets):
    got = {r["id"]: (r["keep_id"], r["similarity"]) for r in D.near_duplicates(words).collect()}
    want = greedy(sets, 0.85)
    gone = {k for k, (j, _) in want.items() if j != k}
    found = {k for k, (j, _) in got.items() if j != k}
    assert sorted(got) == sorted(sets) and len(gone & found) >= 0.9 * len(gone)
    assert all(len(sets[k] & sets[j]) >= 0.85 * len(sets[k] | sets[j]) for k, (j, _) in got.items() if j != k)
    assert {j for j, _ in got.values()} <= set(got) - found  # owners stay


def test_a_family_makes_no_pairs(spark, monkeypatch):
    pairs = []
    likeness = D._likeness
    monkeypatch.setattr(D, "_likeness", lambda p, s: pairs.append(p.count()) or likeness(p, s))
    words = spark.range(400).select("id", F.explode(F.concat(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda x: x.cast("string")), F.array(F.concat(F.lit("own"), "id")))).alias("word"))
    got = D.near_duplicates(words)
    assert got.where("kept").count() <= 3 and sum(pairs) <= 3 * 400


def test_empty(spark, words):
    assert D.near_duplicates(words.limit(0)).count() == 0 and D.exact_duplicates(words.limit(0)).count() == 0


def test_unlike_rows_of_a_common_vocabulary_are_no_candidates(spark):
    r = random.Random(5)
    sets = [(k, [f"c{j}" for j in r.sample(range(400), 100)]) for k in range(3000)]  # similarity about 0.14, like documents of one language
    buckets = D.signature_bands(D.word_sets(spark.createDataFrame(sets, "id long, words array<string>")))
    assert buckets.groupBy("bucket").count().where("count > 1").count() < 30
    assert D.near_duplicates(spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (2, ["c", "b", "a", "a"]), (3, None), (4, [])], "id long, words array<string>")).orderBy("id").collect() == [
        (1, 1, 1.0, True), (2, 1, 1.0, False), (3, 3, 1.0, True), (4, 4, 1.0, True)]
