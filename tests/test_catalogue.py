"""Every query of the catalogue against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from convoweave.plans import catalogue, knowledge_queries  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def flat(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    other = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    order = [other.columns.index(c) for c in sorted(df.columns)]
    ours = sorted(repr([flat(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert ours == sorted(repr([flat(r[k]) for k in order]) for r in other.fetchall())


def test_pair_rules_have_no_product(spark):
    for f in (catalogue.shared_tags, catalogue.temporal):
        plan = f(spark, DIR)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_cleaning_changes_noise(spark):
    from pyspark.sql import functions as F

    from convoweave.functions import cleaning as C

    text = "<thinking>a\nb</thinking>x  y [INST] ```py\n  z  ```\r\n<answering>k</answering>\u0001"
    got = spark.createDataFrame([(text,)], "t string").select(C.clean_message(F.col("t"))).first()[0]
    assert got == "x y ```\nz\n```\nk"


def test_many_fences_are_cleaned_in_one_pass(spark):
    import time

    from pyspark.sql import functions as F

    from convoweave.functions import cleaning as C

    text = "".join(f"  a{k}  b \n\n\n\n```py\n  c {k}\n```  " for k in range(10_000))
    start = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(C.clean_message(F.col("t"))).first()[0]
    assert time.time() - start < 20
    assert got.startswith("a0 b\n\n```\nc 0\n``` a1 b\n\n```\nc 1\n```") and got.endswith("a9999 b\n\n```\nc 9999\n```")


def test_only_non_ascii_texts_are_composed_in_python(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from convoweave.functions import cleaning as C

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counting(s: pd.Series) -> pd.Series:
        seen.add(int(s.notna().sum()))
        return s

    before, C._nfc = C._nfc, counting
    try:
        rows = [(f"plain {k}",) for k in range(100)] + [("caf\u00e9",), (None,)]
        out = spark.createDataFrame(rows, "t string").select(C.compose(F.col("t")).alias("t")).collect()
    finally:
        C._nfc = before
    assert [r["t"] for r in out] == [t for (t,) in rows] and seen.value == 1


def test_concept_links_ranked_has_no_persons_as_concepts(spark, tmp_path):
    said = [(1, 0, "user", "Xabcdefghij met abcdefghij"), (2, 0, "user", "abcdefghij and nothing else")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = catalogue.queries()["concept_links_ranked"](spark, str(tmp_path)).collect()  # person:xabcdefghij ends in the concept's name
    assert sorted((r["conv_id"], r["term"]) for r in rows) == [(1, "abcdefghij"), (1, "xabcdefghij"), (2, "abcdefghij")]
