"""What a query reads or compares only once, as its plan tells."""

from conftest import SF

from tidewatch.operators import filtering, listing


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_not_compared_with_each_other(spark):
    """Pairs of three joins are disjoint, so no aggregate holds them; only those of repeated ids."""
    found = listing.any_of_three(spark, SF)
    assert plan(found).startswith("Union") and found.count() == found.distinct().count() > 0


def test_texts_are_read_once_for_stages(spark):
    """Copies are found on a table of digests: texts are read for the decisions alone."""
    assert plan(filtering.filter_stages(spark, SF)).count("Relation [doc_id") == 1


def test_decisions_are_made_once_for_inherited(spark):
    assert plan(filtering.filter_inherited(spark, SF)).count("Relation [doc_id") == 0
