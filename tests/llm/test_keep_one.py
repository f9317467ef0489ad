"""keep_one by rows: repeated ids with different texts, and null ids."""

import random

from convoweave import shared
from convoweave.llm import ngram_join


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))


def test_keep_one_tells_rows_apart(spark):
    base, near = prose(1, 300), prose(1, 300).split()
    near[150] = "changed"
    near, twin = " ".join(near), prose(2, 80)
    stay = [(3, base), (7, prose(3, 60)), (9, prose(4, 60)), (9, prose(5, 60)), (9, prose(6, 60)), (None, prose(7, 60)), (None, twin), (None, None), (None, ""), (8, ""), (8, " \n")]
    go = [(3, base), (7, near), (7, base), (None, base), (None, near), (None, twin)]
    df = spark.createDataFrame(go + stay, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in ngram_join.keep_one(df).collect()]
    assert sorted(kept, key=repr) == sorted(stay, key=repr)


def test_the_one_that_stays_does_not_depend_on_the_order_of_rows(spark):
    rows = [(3, prose(1, 300), f"s{k % 40:02d}", None if k % 3 else "en") for k in range(400)] + [(k, prose(k, 50), "a", None) for k in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    kept = [sorted(map(tuple, ngram_join.keep_one(df.repartition(n, "source")).collect()), key=repr) for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) == 51 and (3, prose(1, 300), "s00", "en") in kept[0]


def test_texts_are_dealt_once_and_what_a_step_kept_goes(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_VALUES", 0)  # as with many documents
    near = prose(1, 300).split()
    near[150] = "changed"
    rows = [(3, prose(1, 300)), (3, prose(1, 300)), (7, " ".join(near)), (8, prose(2, 80)), (8, prose(2, 80))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = set(shared._staged)
    got = sorted(tuple(r) for r in ngram_join.join_components(df).collect())
    assert [(r[0], r[2], r[4]) for r in got] == [(3, 3, 2), (3, 3, 2), (7, 3, 2), (8, 8, 1), (8, 8, 1)]
    left = {p.rsplit("/", 1)[-1].removeprefix("convoweave-").rsplit("-", 1)[0] for p in set(shared._staged) - before}
    assert left <= {"join-rows", "join-classes", "join-links", "components"}
    assert sorted(tuple(r) for r in ngram_join.keep_one(df).collect()) == [(3, prose(1, 300)), (8, prose(2, 80))]
