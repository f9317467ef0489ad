"""Cases at the edge: sources without words, blank samples, short items, clashing names, extreme ids."""

import random
from collections import Counter

import duckdb

from convoweave.llm import decontamination, mixing, sharding, toxicity, training_order


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))


def test_a_source_without_words_is_mixed(spark):
    rows = [(k, prose(k, 5 + k % 7), "abc"[k % 3]) for k in range(60)] + [(100, None, "b0"), (101, " \n", "b0"), (102, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert len(got) == len(rows) and all(got[k]["taken"] == got[k]["source_size"] == got[k]["target"] == 0 for k in (100, 101, 102))
    taken = Counter(r["doc_id"] for r in mixing.resample(docs).collect())
    assert taken == Counter({k: r["copies"] for k, r in got.items() if r["copies"]})
    words = {s: sum(r["size"] for r in got.values() if r["doc_id"] < 100 and "abc"[r["doc_id"] % 3] == s) for s in "abc"}
    assert {s: got["abc".index(s)]["source_size"] for s in "abc"} == words
    nothing = docs.where("doc_id >= 100")
    assert mixing.mix(nothing).where("taken <> 0").count() == 0 and mixing.resample(nothing).count() == 0


def test_blank_toxic_sample(spark):
    docs = spark.createDataFrame([(k, " " if k % 2 else prose(k, 9)) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, toxic int")
    assert toxicity.tag(docs, labels).where("score <> 0").count() == 0


def test_short_items_and_clashing_names(spark, tmp_path):
    docs = [(1, prose(1, 30) + " Secret  CODE. " + prose(2, 9), "x"), (2, prose(3, 30), "x"), (3, "secret", "x"), (4, None, "x"), (5, "code secret", "x"), (1, "secret code", "x"), (None, "a b c d e f", "x")]
    bench = [(1, "secret code"), (2, None), (3, " - "), (4, "w7"), (5, "b c d e"), (6, prose(3, 30))]
    spark.createDataFrame(docs, "doc_id long, text string, bad_id string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    columns = "doc_id, item_id, n_item_shingles, n_shared, containment"
    got = decontamination.query(spark, str(tmp_path)).select(*columns.split(", ")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, duck.sql(f"SELECT {columns} FROM ({decontamination.SQL})").fetchall()))
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(1, 1), (2, 6), (None, 5)}
    d, b = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    assert {r["text"] for r in decontamination.decontaminate(d, b.where("item_id in (1, 5)")).collect()} == {prose(3, 30), "secret", None, "code secret"}
    assert decontamination.decontaminate(d, b.where("false")).count() == len(docs)


def test_shards_are_near_equal_in_bytes(spark):
    rows = [(k, prose(k, 1 + k % 50)) for k in range(800)] + [(-(1 << 63), "least"), (None, "none"), (None, "none"), (5, prose(5, 6))]
    rows += [(10_000 + k, "copy of one text") for k in range(6)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    assert len(got) == len(rows) and Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    total = Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    assert set(total) == set(range(8)) and max(total.values()) - min(total.values()) <= 4 * max(r["size"] for r in got)
    assert len({r["shard"] for r in got if (r["doc_id"] or 0) >= 10_000}) == 1


def test_feistel_order_does_not_depend_on_other_partitions():
    stream = [training_order.Stream(k, 3, training_order.KEY) for k in (0, 1)]
    for s in stream:
        for doc in range(40):
            s.add(doc, bytes(2 * (50 + doc)))
    blocks = [s.take(True) for s in stream]
    numbers = [x for b in blocks for x in b["sequence"].explode()]
    assert len(set(numbers)) == len(numbers) and {n // training_order.PART_SEQUENCES for n in numbers} == {0, 1}
    assert all((x // stream[0].width == r["shard"]).all() for b in blocks for _, r in b.iterrows() for x in [r["place"]])


def test_a_third_of_all_rows_are_one_row(spark):
    """Rows that repeat one id and text, more than several shards hold, are split like any others."""
    rows = [(k, "same " * 4 + f"{k:05d}") for k in range(2000)] + [(7, "the hot row of all these rows!")] * 1000 + [(None, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(docs, 16).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    total, slots = Counter(), Counter()
    for r in got:
        total[r["shard"]] += r["size"]
        slots[r["shard"], r["slot"]] += 1
    mean = sum(total.values()) / 16
    assert set(total) == set(range(16)) and all(abs(x - mean) <= 0.03 * mean for x in total.values())
    assert set(slots.values()) == {1}
