"""Choices by several orders, quotas and even splits, against plain statements of the rules."""

import random
from collections import defaultdict

import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from tidewatch.functions.positions import with_positions
from tidewatch.operators import choices


@pytest.mark.parametrize("name", sorted(choices.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    same(choices.QUERIES[name](spark, SF), duck, choices.ORACLE_SQL[name])


@pytest.mark.parametrize("group", [["g"], []])
def test_positions_over_many_ranges(spark, group):
    draw = random.Random(3)
    rows = [(draw.choice([None, 1, 1, 1, 2]), draw.randint(0, 9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v int, i int").repartition(7)
    got = {r["i"]: r["position"] for r in with_positions(df, group, [F.desc("v"), F.col("i")]).collect()}
    seen, want = defaultdict(int), {}
    for g, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        key = g if group else 0
        want[i] = seen[key]
        seen[key] += 1
    assert got == want
    assert with_positions(df.limit(0), group, [F.col("i")]).collect() == []


def test_ranked_union_against_brute_force(spark):
    draw = random.Random(5)
    rows = [(t, c, draw.choice([None, 0, 1, 2]), draw.random()) for t in range(20) for c in range(draw.randint(0, 40))]
    df = spark.createDataFrame(rows, "t int, c int, x int, y double").repartition(5)
    found = choices.ranked_union(df, "t", "c", {"x": ([F.col("x")], 3), "y": ([F.col("y"), F.col("x")], 7)})
    got = {(r["t"], r["c"]): r["orders"] for r in found.collect()}
    want = defaultdict(list)
    for t in range(20):
        of = [r for r in rows if r[0] == t]
        for r in sorted(of, key=lambda r: (-(-1 if r[2] is None else r[2]), r[1]))[:3]:
            want[t, r[1]].append("x")
        for r in sorted(of, key=lambda r: -r[3])[:7]:
            want[t, r[1]].append("y")
    assert got == want
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_history_is_bounded_across_blocks(spark):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 2, start + dt.timedelta(minutes=i // 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "article_id long, company_id long, seen_at timestamp_ntz")
    got = sorted((r["a"]["article_id"], r["b"]["article_id"]) for r in choices.candidate_pairs(df, history=4).collect())
    assert got == sorted((i, j) for i in range(60) for j in range(60) if i % 2 == j % 2 and 0 < i - j <= 8)


def test_quota_leaves_room_to_the_others(spark):
    rows = [("a", i, f"t{i}", i < 20) for i in range(40)] + [("b", i, f"t{i % 3}", False) for i in range(40)] + [("c", i, f"t{i}", i < 1) for i in range(40)] + [("d", 1, None, True), ("d", 2, "x", True), ("d", 3, "x", False)]
    df = spark.createDataFrame(rows, "g string, i int, title string, inc boolean")
    got = defaultdict(list)
    for r in choices.with_quota(df, "g", "inc", F.col("i").asc(), "title", 9).collect():
        got[r["g"]].append((r["inc"], r["i"]))
    assert {g: sorted(v) for g, v in got.items()} == {"a": [(False, i) for i in range(20, 26)] + [(True, i) for i in range(3)], "b": [(False, i) for i in range(3)], "c": [(False, i) for i in range(1, 9)] + [(True, 0)], "d": [(True, 2)]}


def test_folds_are_even_over_all_groups(spark):
    rows = choices.even_group_folds(spark, SF).collect()
    for y in (0, 1):
        of = [r for r in rows if r["y"] == y]
        groups, sizes = [0] * choices.FOLDS, [0] * choices.FOLDS
        for r in of:
            groups[r["fold"]] += 1
            sizes[r["fold"]] += r["n"]
        assert max(groups) - min(groups) <= 1 and max(sizes) - min(sizes) <= max(r["n"] for r in of)


def test_no_story_is_in_two_splits(spark):
    rows = choices.timed_group_split(spark, SF).collect()
    assert len({(r["company_id"], r["story"]) for r in rows}) == len(rows)
    share = sum(r["split"] == "train" for r in rows) / len(rows)
    assert abs(share - 0.7) <= 1 / len(rows)


def test_histories_against_pairs(spark):
    """Ordered arrays choose what one window over all pairs chooses, with nulls, and make no pairs."""
    import datetime as dt
    import random

    draw = random.Random(3)
    rows = [(i, draw.choice([0, 1, None]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=draw.randrange(40)), draw.choice([1.5, 2.0, 3.0, None])) for i in range(60)]
    df = spark.createDataFrame(rows, "article_id long, company_id long, seen_at timestamp_ntz, x double")
    pairs = choices.candidate_pairs(df, history=7).select(F.col("a.article_id").alias("t"), F.col("b.article_id").alias("c"), F.col("b.position").alias("at"), F.abs(F.col("a.x") - F.col("b.x")).alias("apart"))
    want = {(r["t"], r["c"]): r["orders"] for r in choices.ranked_union(pairs, "t", "c", {"near": ([-F.col("apart"), F.col("at")], 3), "time": ([F.col("at")], 2)}).collect()}
    found = choices.ranked_histories(df, {"near": (lambda a, b: [-F.abs(a["x"] - b["x"])], 3), "time": (lambda a, b: [], 2)}, history=7)
    got = {}
    for r in found.collect():
        for name in ("near", "time"):
            for c in r[name]:
                got.setdefault((r["article_id"], c), []).append(name)
    assert want and got == want
