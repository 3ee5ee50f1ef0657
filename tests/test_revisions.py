"""Versions of a table and the changes between them."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import revisions
from tidewatch.sources.versions import Versions, changes

LINK = "company_id long, story long, article_id long, score double, credibility double"


def test_versions(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/t", "a long")
    assert table.newest() == 0 and table.read().collect() == []
    with pytest.raises(ValueError):
        table.write(spark.range(1).select(F.col("id").alias("a")), 2)
    for n in (1, 2):
        table.write(spark.range(n).select(F.col("id").alias("a")), n)
    assert table.newest() == 2 and table.read().count() == 2 and table.read(1).count() == 1
    table.write(spark.range(5).select(F.col("id").alias("a")), 2)
    assert table.newest() == 2 and table.read().count() == 5


def test_changes(spark):
    before = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, None, 0.5), (2, 1, None), (2, 2, None)], "a long, b long, v double")
    after = spark.createDataFrame([(1, 1, 0.54), (1, None, 0.44), (3, 3, 0.1), (2, 1, 0.2), (2, 2, None)], "a long, b long, v double")
    got = {(r["a"], r["b"]): r["change"] for r in changes(before, after, ["a", "b"], "v", 0.05).collect()}
    assert got == {(1, 2): "removed", (1, None): "revised", (3, 3): "added", (2, 1): "revised"}
    assert changes(before.limit(0), after.limit(0), ["a", "b"], "v", 0.05).collect() == []


def test_counters_over_runs(spark, tmp_path):
    """Small moves don't count, also if they add up; events without evidence keep their counter;
    a repeated run changes nothing."""
    links, counters, told = (Versions(spark, f"file://{tmp_path}/{n}", s) for n, s in (("l", revisions.LINKS), ("c", revisions.COUNTERS), ("t", revisions.CHANGES)))
    frame = lambda rows: spark.createDataFrame(rows, LINK)
    steps = [
        ([(1, 1, 10, 0.50, 0.5), (1, 1, 11, 0.50, 0.5), (2, 1, 12, 0.5, 0.9)], {(1, 1): (2, 0, 0, False, 2), (2, 1): (1, 0, 0, True, 1)}),
        ([(1, 1, 10, 0.54, 0.5), (1, 1, 11, 0.60, 0.5)], {(1, 1): (0, 0, 1, False, 3), (2, 1): (0, 1, 0, False, 2)}),
        ([(1, 1, 10, 0.58, 0.5), (1, 1, 13, 0.60, 0.95)], {(1, 1): (1, 1, 0, True, 5), (2, 1): (0, 0, 0, False, 2)}),
    ]
    for n, (rows, want) in enumerate(steps, 1):
        for _ in range(2):
            got = {(r["company_id"], r["story"]): (r["added"], r["removed"], r["revised"], r["new_official"], r["revision"]) for r in revisions.run(links, counters, told, n, frame(rows), F.col("company_id") == 2).collect()}
            assert got == want
    assert {(r["company_id"], r["answered"]) for r in counters.read().collect()} == {(1, 0), (2, 2)}
