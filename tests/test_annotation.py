"""Prompts, responses, retries and the rule-based tagger."""

import pytest
from pyspark.sql import functions as F

from convoweave.operators import annotation as A
from convoweave.sources import config


def one(spark, response, expected):
    df = spark.createDataFrame([(response, expected)], "r string, n int")
    return [x.asDict() for x in df.select(A.parse_tags(F.col("r"), F.col("n")).alias("x")).first()["x"]]


DEFAULT = {"tags": [], "category": "uncategorized", "confidence": {}}


@pytest.mark.parametrize("response", [None, "", "no json", "[1, 2", "[not json]"])
def test_unreadable_tags_get_defaults(spark, response):
    assert one(spark, response, 2) == [DEFAULT, DEFAULT]


def test_tags_are_read_from_text_around_them(spark):
    text = 'Here: [{"tags": ["a", "b"], "category": "x", "confidence": {"a": 0.9}}] done'
    assert one(spark, text, 2) == [{"tags": ["a", "b"], "category": "x", "confidence": {"a": 0.9, "b": 0.5}}, DEFAULT]
    assert one(spark, '{"tags": ["q"]}', 1) == [{"tags": ["q"], "category": "uncategorized", "confidence": {"q": 0.5}}]
    many = '[{"tags": ["a","b","c","d","e","f","g","h"], "category": null}]'
    assert one(spark, many, 1)[0]["tags"] == list("abcdefg")
    assert one(spark, "[]", 0) == []


def test_extractions(spark):
    rows = ['```json\n{"key_decisions": ["d"], "concepts": ["c1", "c2"], "summary": "s"}\n```', "garbage", None, '{"summary": null}']
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, r string").select("k", A.parse_extraction(F.col("r")).alias("x")).select("k", "x.*")
    got = {r["k"]: r for r in df.collect()}
    assert got[0]["key_decisions"] == ["d"] and got[0]["concepts"] == ["c1", "c2"] and got[0]["insights"] == [] and got[0]["summary"] == "s"
    assert got[1]["concepts"] == [] and got[1]["summary"] == A.UNREADABLE == got[2]["summary"] and got[3]["summary"] == ""
    assert tuple(A.extraction_totals(df).first()) == (1, 0, 0, 2, 0)


def test_retries():
    calls, pauses = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise A.RateLimited()
        if len(calls) == 3:
            raise ValueError("once")
        return "ok"

    assert A.call_with_retry(flaky, "p", 5, pauses.append) == "ok" and len(calls) == 4
    assert 1 <= pauses[0] < 2 and 2 <= pauses[1] < 3 and pauses[2] == 1.0
    with pytest.raises(ZeroDivisionError):
        A.call_with_retry(lambda p: 1 / 0, "p", 2, pauses.append)


def test_batches_reach_their_conversations(spark):
    digests = spark.createDataFrame([(k, f"text {k}") for k in range(13)], "conv_id long, digest string").repartition(2)
    prompts = A.tag_prompts(digests, "- a: b", 5)
    sizes = [len(r["conv_ids"]) for r in prompts.collect()]
    assert sum(sizes) == 13 and max(sizes) <= 5 and all("- a: b" in r["prompt"] for r in prompts.collect())

    def make():
        import re

        def call(prompt):
            ids = re.findall(r"text (\d+)", prompt)
            if "7" in ids:
                raise ValueError("refused")
            return "[" + ",".join(f'{{"tags": ["t{k}"], "category": "c"}}' for k in ids) + "]"

        return call

    answered = A.annotate(prompts, make, at_once=2, attempts=1)
    bad = [r for r in answered.collect() if r["error"]]
    assert len(bad) == 1 and 7 in bad[0]["conv_ids"] and "refused" in bad[0]["error"]
    for r in A.tagged(answered).collect():
        assert r["tags"] == ([] if r["conv_id"] in bad[0]["conv_ids"] else [f"t{r['conv_id']}"])


def test_rule_tags_and_taxonomy(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"work": {"code": ["python", "spark"], "ops": []}, "home": ["garden"]}')
    words = spark.createDataFrame([(1, "python", 2), (1, "spark", 1), (1, "garden", 1), (2, "ops", 1), (3, "other", 9)], "conv_id long, word string, n long")
    got = sorted(map(tuple, A.rule_tags(words, config.taxonomy(spark, str(path))).collect()))
    assert got == [(1, "code", 3, 1.0, 1, "work"), (1, "garden", 1, 0.333333, 2, "work"), (2, "ops", 1, 1.0, 1, "work")]
    assert config.taxonomy_text({"work": {"code": ["python"]}}) == "- work: code"
    (tmp_path / "s.toml").write_text("min_messages = 5\n[vault]\nlayout = 'flat'\n")
    assert (config.settings(str(tmp_path / "s.toml")).min_messages, config.settings(str(tmp_path / "s.toml")).layout, config.settings().max_tags) == (5, "flat", 7)
    (tmp_path / "bad.json").write_text('{"nonsense": 1}')
    with pytest.raises(ValueError):
        config.settings(str(tmp_path / "bad.json"))
