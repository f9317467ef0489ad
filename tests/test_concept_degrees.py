"""What only needs the degrees of concepts makes no pairs of conversations."""

import pytest

from convoweave.plans import knowledge_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["most_connected_concepts", "concept_links_importance", "moc_key_concepts", "moc_pages"])
def test_no_pairs_for_concepts(spark, monkeypatch, name):
    def never(*_):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(Q.K, "pair_table", never)
    assert Q.B.queries()[name](spark, SF).count() > 0
