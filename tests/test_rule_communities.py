"""communities_k4 and communities write their edges once, one way, and give what label propagation over all links gives."""

from pyspark.sql import functions as F

from convoweave import shared
from convoweave.operators import knowledge as K
from convoweave.plans import catalogue, knowledge_queries  # noqa: F401


def test_communities_write_no_links_both_ways(spark, tmp_path):
    rows = [(k, 0, "user", f"alpha{'abc'[k % 3]} betas{'de'[k % 2]} gamma") for k in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    d, before = str(tmp_path), set(shared._staged)
    got = sorted(map(tuple, catalogue.queries()["communities_k4"](spark, d).collect()))
    assert not any("community-links" in p for p in set(shared._staged) - before)
    want = K.communities(catalogue.conv(spark, d).select(F.col("conv_id").alias("id")), catalogue.edges(spark, d), 4, settle=False)
    assert got == sorted(map(tuple, want.collect()))
