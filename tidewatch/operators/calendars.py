"""Dates and times: Seoul days and ranges, parsing, windows, slots, month grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.sources.tables import ARTICLES_SQL, articles, table

#: Seoul is nine hours ahead of UTC all year; both sides count on plain UTC times.
SEOUL_HOURS = 9
#: Empty days after which a story's event closes; minutes of a collection slot.
INACTIVE_DAYS, SLOT_MINUTES = 3, 45


def seoul(at: Column) -> Column:
    """Local time in Seoul of a UTC time without zone."""
    return at + F.expr(f"INTERVAL {SEOUL_HOURS} HOURS")


def seoul_midnight(day: Column) -> Column:
    """The UTC time at which a date begins in Seoul."""
    return day.cast("timestamp_ntz") - F.expr(f"INTERVAL {SEOUL_HOURS} HOURS")


def seoul_daily(spark, sf_dir):
    """Articles and stories by Seoul day, newest first, days without any as 0."""
    rows = articles(spark, sf_dir).withColumn("day", F.to_date(seoul(F.col("seen_at"))))
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("label") == "negative").alias("negative_articles"), F.countDistinct("company_id", "story").alias("stories"))
    return rows.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day")).join(days, "day", "left").na.fill(0)


def admin_trend(spark, sf_dir):
    """Articles and risks by server day; the days are those of either."""
    rows = articles(spark, sf_dir)
    of_articles = rows.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("articles"))
    of_risks = rows.where("negative >= 0.95").groupBy(F.to_date("seen_at").alias("day")).agg(F.countDistinct("company_id", "story").alias("risks"))
    days = of_articles.select("day").union(of_risks.select("day")).distinct()
    return days.join(of_articles, "day", "left").join(of_risks, "day", "left").na.fill(0)


def seoul_ranges(spark, sf_dir):
    """For each order's date as today: the UTC bounds of the last 7 Seoul days including
    it, half-open, and the first of its month in Seoul."""
    today = F.to_date(seoul(F.col("o_orderdate")))
    first = F.date_sub(today, 6)
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("start_day"), seoul_midnight(first).alias("start_at"), seoul_midnight(F.date_add(today, 1)).alias("end_at"), seoul_midnight(F.trunc(today, "month")).alias("month_at"))


def inactivity_bounds(spark, sf_dir):
    """When a story's event may close, Seoul days counted: closure after three empty
    days, and whether it is past on the 28th."""
    rows = articles(spark, sf_dir).groupBy("company_id", "story").agg(F.max("seen_at").alias("last_at"))
    today = F.to_date(seoul(F.lit("2024-01-28 20:00:00").cast("timestamp_ntz")))
    cutoff = seoul_midnight(F.date_sub(today, INACTIVE_DAYS))
    closes = seoul_midnight(F.date_add(F.to_date(seoul(F.col("last_at"))), INACTIVE_DAYS + 1))
    return rows.select("company_id", "story", closes.alias("closes_at"), (F.col("last_at") < cutoff).alias("closable"))


def event_reopen(spark, sf_dir):
    """Stories whose event closed for lack of evidence and opened again when more came:
    each gap of more than the empty days, with closure and reopening."""
    from pyspark.sql import Window

    order = Window.partitionBy("company_id", "story").orderBy("day")
    days = articles(spark, sf_dir).select("company_id", "story", F.to_date(seoul(F.col("seen_at"))).alias("day")).distinct()
    rows = days.withColumn("last_day", F.lag("day").over(order)).where(F.datediff("day", "last_day") > INACTIVE_DAYS)
    return rows.select("company_id", "story", seoul_midnight(F.date_add("last_day", INACTIVE_DAYS + 1)).alias("closed_at"), F.col("day").alias("reopened_on"))


def parsed_dates(spark, sf_dir):
    """Dates in four spellings, one of them none at all, as times; null if unreadable."""
    i, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    mail = F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss Z")
    text = F.when(i % 4 == 0, mail).when(i % 4 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 4 == 2, F.date_format(at, "yyyyMMdd")).otherwise(F.concat(F.lit("on "), F.date_format(at, "yyyy")))
    read = F.coalesce(F.try_to_timestamp(F.substr("text", F.lit(6), F.lit(20)), F.lit("dd MMM yyyy HH:mm:ss")), F.try_to_timestamp("text", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")), F.try_to_timestamp("text", F.lit("yyyyMMdd")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    fixed = F.regexp_replace("text", "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    return rows.select("o_orderkey", read.cast("timestamp_ntz").alias("at"), F.when(F.col("o_orderkey") % 4 == 2, fixed).alias("fixed"))


def time_features(spark, sf_dir):
    """Of each article: its last complete window, Seoul hour and weekday (Monday 0), if a
    collection slot is due in its minute, and hours between publication and creation."""
    local = seoul(F.col("seen_at"))
    minutes = F.floor(F.unix_seconds(F.col("seen_at").cast("timestamp")) / 60)
    window = F.timestamp_seconds((F.floor(minutes / 15) - 1) * 900).cast("timestamp_ntz")
    gap = F.abs(F.unix_seconds(F.col("published_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))) / 3600
    return articles(spark, sf_dir).select("article_id", window.alias("last_window"), F.hour(local).cast("long").alias("hour"), F.weekday(local).cast("long").alias("weekday"), (F.pmod(minutes, F.lit(SLOT_MINUTES)) == 0).alias("slot_due"), F.round(gap, 6).alias("gap_hours"))


def month_grid(spark, sf_dir):
    """The 42 days of a month's calendar from the Monday on or before its first, for all
    months of orders, and the same day of the next month (clamped)."""
    months = table(spark, sf_dir, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).distinct()
    first = F.date_sub("month", F.weekday("month"))
    days = months.select("month", F.explode(F.sequence(first, F.date_add(first, 41))).alias("day"))
    return days.select("month", "day", (F.trunc("day", "month") == F.col("month")).alias("inside"), F.add_months("day", 1).alias("next_month"))


QUERIES = {f.__name__: f for f in (seoul_daily, admin_trend, seoul_ranges, inactivity_bounds, event_reopen, parsed_dates, time_features, month_grid)}

_S = f"INTERVAL {SEOUL_HOURS} HOURS"
ORACLE_SQL = {
    "seoul_daily": f"""WITH {ARTICLES_SQL}, r AS (SELECT *, CAST(seen_at + {_S} AS DATE) AS day FROM articles), d AS (SELECT day, count(*) AS articles, count(*) FILTER (WHERE label = 'negative') AS negative_articles, count(DISTINCT (company_id, story)) AS stories FROM r GROUP BY day),
      s AS (SELECT CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM r) SELECT s.day, coalesce(articles, 0) AS articles, coalesce(negative_articles, 0) AS negative_articles, coalesce(stories, 0) AS stories FROM s LEFT JOIN d USING (day)""",
    "admin_trend": f"""WITH {ARTICLES_SQL}, a AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS articles FROM articles GROUP BY 1), k AS (SELECT CAST(seen_at AS DATE) AS day, count(DISTINCT (company_id, story)) AS risks FROM articles WHERE negative >= 0.95::DOUBLE GROUP BY 1), d AS (SELECT day FROM a UNION SELECT day FROM k)
      SELECT day, coalesce(articles, 0) AS articles, coalesce(risks, 0) AS risks FROM d LEFT JOIN a USING (day) LEFT JOIN k USING (day)""",
    "seoul_ranges": f"""WITH t AS (SELECT o_orderkey, CAST(o_orderdate + {_S} AS DATE) AS today FROM orders) SELECT o_orderkey, CAST(today - 6 AS DATE) AS start_day, CAST(today - 6 AS TIMESTAMP) - {_S} AS start_at, CAST(today + 1 AS TIMESTAMP) - {_S} AS end_at, CAST(date_trunc('month', today) AS TIMESTAMP) - {_S} AS month_at FROM t""",
    "inactivity_bounds": f"""WITH {ARTICLES_SQL}, s AS (SELECT company_id, story, max(seen_at) AS last_at FROM articles GROUP BY ALL) SELECT company_id, story, CAST(CAST(last_at + {_S} AS DATE) + 4 AS TIMESTAMP) - {_S} AS closes_at, last_at < CAST(DATE '2024-01-29' - 3 AS TIMESTAMP) - {_S} AS closable FROM s""",
    "event_reopen": f"""WITH {ARTICLES_SQL}, d AS (SELECT DISTINCT company_id, story, CAST(seen_at + {_S} AS DATE) AS day FROM articles), r AS (SELECT *, lag(day) OVER (PARTITION BY company_id, story ORDER BY day) AS last_day FROM d)
      SELECT company_id, story, CAST(last_day + 4 AS TIMESTAMP) - {_S} AS closed_at, day AS reopened_on FROM r WHERE day - last_day > 3""",
    "parsed_dates": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 1 THEN date_trunc('second', o_orderdate) WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS at, CASE WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS fixed FROM orders""",
    "time_features": f"""WITH {ARTICLES_SQL} SELECT article_id, time_bucket(INTERVAL 15 MINUTES, seen_at, TIMESTAMP '1970-01-01') - INTERVAL 15 MINUTES AS last_window, hour(seen_at + {_S}) AS hour, CAST(isodow(seen_at + {_S}) - 1 AS BIGINT) AS weekday, CAST(floor(epoch(seen_at) / 60) AS BIGINT) % {SLOT_MINUTES} = 0 AS slot_due,
      round(abs(epoch(date_trunc('second', published_at)) - epoch(date_trunc('second', created_at))) / 3600, 6) AS gap_hours FROM articles""",
    "month_grid": """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), f AS (SELECT month, CAST(month - CAST(isodow(month) - 1 AS INT) AS DATE) AS first FROM m), d AS (SELECT month, CAST(first + CAST(i AS INT) AS DATE) AS day FROM f, range(42) t(i))
      SELECT month, day, date_trunc('month', day) = month AS inside, CAST(day + INTERVAL 1 MONTH AS DATE) AS next_month FROM d""",
}
