"""Backfill of feature windows: only those that late rows touch are built again, and only the
windows from the first of them on are scored again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import with_robust_z
from tidewatch.operators.series import ORACLE_SQL as SERIES_SQL
from tidewatch.operators.series import feature_windows, with_quality
from tidewatch.sources.scratch import shared_folder
from tidewatch.sources.tables import articles
from tidewatch.sources.versions import Versions

WIDTH, TRAILING = "6 hours", 672
STORED = "company_id long, window_start timestamp_ntz, articles long, quality string, z double"
#: From here on some of the queries' articles come late.
LATE_FROM = "2024-01-20"


def built(rows: DataFrame) -> DataFrame:
    """Windows of articles as they are stored, without their score."""
    return with_quality(feature_windows(rows, WIDTH)).select("company_id", "window_start", "articles", "quality")


def _with_before(windows: DataFrame) -> DataFrame:
    """windows with the number of usable ones before each in its company."""
    earlier = Window.partitionBy("company_id").orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    return windows.withColumn("before", F.coalesce(F.sum((F.col("quality") != "unavailable").cast("long")).over(earlier), F.lit(0)))


def _with_z(windows: DataFrame) -> DataFrame:
    """windows (with `before`) with the robust z of their articles over the usable windows
    before, TRAILING at most; those that it rests on must be there."""
    frame = Window.partitionBy("company_id").orderBy("before").rangeBetween(-TRAILING, -1)
    history = F.collect_list(F.when(F.col("quality") != "unavailable", F.col("articles").cast("double"))).over(frame)
    return with_robust_z(windows.withColumn("history", history), "articles", "history").drop("history")


def scored(windows: DataFrame) -> DataFrame:
    return _with_z(_with_before(windows)).select("company_id", "window_start", "articles", "quality", "z")


def backfilled(stored: DataFrame, rows: DataFrame, late: DataFrame) -> DataFrame:
    """The table of windows after late articles: `stored` is what was built without them,
    `rows` are all articles now, `late` those that came since. Adds `rebuilt` and `rescored`.

    Only windows with a late article are built again. A window's count enters the scores of
    the windows after it, so a company's windows are scored again from its first rebuilt one
    on, from those and the TRAILING usable ones before. Companies without late articles keep
    all they have. Null companies are a company; articles without a time have no window."""
    start = F.window("seen_at", WIDTH)["start"]
    touched = late.where(F.col("seen_at").isNotNull()).select(F.col("company_id").alias("t_company"), start.alias("t_start")).distinct()
    hit = lambda at: F.col("company_id").eqNullSafe(F.col("t_company")) & (at == F.col("t_start"))
    again = built(rows.withColumn("at", start).join(touched, hit(F.col("at")), "left_semi").drop("at")).withColumn("rebuilt", F.lit(True))
    kept = stored.join(touched, hit(F.col("window_start")), "left_anti").withColumn("rebuilt", F.lit(False))
    windows = kept.unionByName(again.withColumn("z", F.lit(None).cast("double")))
    first = touched.groupBy("t_company").agg(F.min("t_start").alias("first"))
    windows = windows.join(first, F.col("company_id").eqNullSafe(F.col("t_company")), "left").drop("t_company")
    calm = windows.where(F.col("first").isNull()).withColumn("rescored", F.lit(False))
    moved = _with_before(windows.where(F.col("first").isNotNull())).withColumn("rescored", F.col("window_start") >= F.col("first"))
    from_here = F.min(F.when(F.col("rescored"), F.col("before"))).over(Window.partitionBy("company_id"))
    moved = moved.withColumn("needed", F.col("before") >= from_here - TRAILING)
    new = _with_z(moved.where("needed").drop("z"))
    columns = ["company_id", "window_start", "articles", "quality", "z", "rebuilt", "rescored"]
    return calm.select(columns).unionByName(moved.where("not rescored").select(columns)).unionByName(new.where("rescored").select(columns))


def window_backfill(spark, sf_dir):
    """Windows of six hours, stored before one in thirteen of the articles since LATE_FROM was
    there, and backfilled with these: the second version of the table."""
    rows = articles(spark, sf_dir)
    late = F.coalesce((F.col("article_id") % 13 == 5) & (F.col("seen_at") >= F.lit(LATE_FROM).cast("timestamp_ntz")), F.lit(False))
    table = Versions(spark, shared_folder(spark), f"{STORED}, rebuilt boolean, rescored boolean")
    first = scored(built(rows.where(~late))).withColumns({"rebuilt": F.lit(True), "rescored": F.lit(True)})
    stored = table.write(first, 1).drop("rebuilt", "rescored")
    second = table.write(backfilled(stored, rows, rows.where(late)), 2)
    return second.withColumn("z", F.round("z", 6))


QUERIES = {f.__name__: f for f in (window_backfill,)}

#: The scores are those of all windows built at once.
ORACLE_SQL = {
    "window_backfill": f"""WITH whole AS ({SERIES_SQL['window_robust_z'].replace('SELECT company_id, window_start, quality, round(', 'SELECT company_id, window_start, articles, quality, round(')}),
      late AS (SELECT DISTINCT user_id % 50 AS company_id, time_bucket(INTERVAL '6 hours', seen_at, TIMESTAMP '1970-01-01') AS window_start FROM (SELECT *, CASE WHEN event_id % 7 <> 0 THEN ts - to_minutes(CAST(event_id % 11 * 7 AS INT)) ELSE ts END AS seen_at FROM events)
        WHERE event_id % 13 = 5 AND seen_at >= TIMESTAMP '{LATE_FROM}'),
      f AS (SELECT company_id, min(window_start) AS first FROM late GROUP BY 1)
      SELECT w.*, l.company_id IS NOT NULL AS rebuilt, coalesce(w.window_start >= f.first, FALSE) AS rescored FROM whole w LEFT JOIN late l ON l.company_id = w.company_id AND l.window_start = w.window_start LEFT JOIN f ON f.company_id = w.company_id""",
}
