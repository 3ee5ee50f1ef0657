"""Windows over late and repeated articles: the stream, and the backfill of a stored table."""

import datetime as dt

import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from tidewatch.operators import backfill
from tidewatch.streaming import arrivals
from tidewatch.streaming.windows import newest

START = dt.datetime(2024, 1, 1)


def test_backfill_matches_its_sql(spark, duck):
    same(backfill.window_backfill(spark, SF), duck, backfill.ORACLE_SQL["window_backfill"])


def test_stream_matches_its_sql(spark, duck):
    same(arrivals.late_windows(spark, SF), duck, arrivals.ORACLE_SQL["late_windows"])


ROWS = "article_id long, company_id long, seen_at timestamp_ntz, story long, source string, negative double"


@pytest.mark.parametrize("trailing", [4, 672])
def test_backfill_equals_a_whole_computation(spark, monkeypatch, trailing):
    """Companies without late rows, with late rows at the start, in the middle, in new windows
    and in windows whose quality they change; a null company; a short trailing history."""
    monkeypatch.setattr(backfill, "TRAILING", trailing)
    rows, late = [], set()
    for c in (None, 0, 1, 2):
        for i in range(60):
            at = START + dt.timedelta(hours=3 * i + (c or 0))
            rows.append((len(rows), c, at, i % 5, "error" if i % 7 == 0 else "view", (i % 10) / 10))
            if (c == 0 and i == 0) or (c == 1 and i in (30, 31, 42, 43)) or (c is None and i == 59):
                late.add(len(rows) - 1)
    df = spark.createDataFrame(rows, ROWS)
    is_late = F.col("article_id").isin(sorted(late))
    stored = backfill.scored(backfill.built(df.where(~is_late)))
    got = backfill.backfilled(stored, df, df.where(is_late)).collect()
    key = lambda r: (r["company_id"] or -1, r["window_start"], r["articles"], r["quality"], r["z"])
    assert sorted(map(key, got)) == sorted(map(key, backfill.scored(backfill.built(df)).collect()))
    assert not any(r["rescored"] for r in got if r["company_id"] == 2) and all(r["rescored"] for r in got if r["company_id"] == 0)
    assert {r["company_id"] for r in got if r["rebuilt"]} == {None, 0, 1}
    nothing = backfill.backfilled(stored, df.where(~is_late), df.limit(0)).collect()
    assert not any(r["rebuilt"] or r["rescored"] for r in nothing) and len(nothing) == stored.count()


def test_repeated_and_late_articles_in_runs(spark, tmp_path):
    """An article read again counts once; one that comes late corrects its window; one that is
    too late is left out."""
    folder, state, kept = (f"{tmp_path}/{x}" for x in ("arrived", "state", "windows"))
    frame = lambda rows: spark.createDataFrame([(i, c, START + dt.timedelta(minutes=m), v) for i, c, m, v in rows], arrivals.ARRIVED)
    first = frame([(1, 7, 600, 0.5), (2, 7, 601, 0.1), (3, None, 660, 0.2)])
    second = frame([(2, 7, 601, 0.1), (3, None, 660, 0.2), (4, 7, 602, 0.9), (5, 7, 700, 0.3), (6, 7, 10, 0.3)])
    for rows in (first, second):
        arrivals.collect(first, folder, state, kept, rows)
    got = {(r["company_id"], r["window_start"], r["articles"], r["max_negative"]) for r in newest(spark, kept).collect()}
    at = lambda m: START + dt.timedelta(minutes=m)
    assert got == {(7, at(600), 3, 0.9), (None, at(660), 1, 0.2), (7, at(690), 1, 0.3)}
