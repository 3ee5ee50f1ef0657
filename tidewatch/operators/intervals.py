"""Joins by time and containment: closed intervals, as-of at or before, bands, terms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.terms import LATIN, prepared_terms, texts_holding
from tidewatch.operators.filtering import ITEMS_SQL, items
from tidewatch.operators.series import ORACLE_SQL as SERIES_SQL
from tidewatch.operators.series import feature_windows, hysteresis_events
from tidewatch.sources.tables import ARTICLES_SQL, articles, table

#: Terms looked for in texts, one row each: a table that grows with the companies.
TERMS = ["thor", "erin", "eaun", "stand", "anea", "onan", "erble", "attion", "queau", "password", "of the", "de la", "in the and", "licensed under"]
#: Hours within which articles may tell one story.
HORIZON_HOURS = 6
#: Order lines that meet their orders in one task.
LINES_A_TASK = 500_000


def _spans(spark, sf_dir) -> DataFrame:
    """Labelled periods: events of companies, from their opening to their last sight."""
    return hysteresis_events(spark, sf_dir).where("windows >= 3").select("company_id", "event", "opened_at", "last_seen_at")


def _in_days(rows: DataFrame, start, end) -> DataFrame:
    """Rows once for each day that they touch, as column `day`: intervals meet points by
    day first, so a company's rows are compared within a day only."""
    return rows.withColumn("day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))


def windows_of_events(spark, sf_dir):
    """Windows that start within a labelled period, both ends included, as its rows."""
    win = feature_windows(articles(spark, sf_dir), "15 minutes").select("company_id", "window_start", "articles").withColumn("day", F.to_date("window_start"))
    spans = _in_days(_spans(spark, sf_dir), F.col("opened_at"), F.col("last_seen_at"))
    met = win.join(spans, ["company_id", "day"]).where(F.col("window_start").between(F.col("opened_at"), F.col("last_seen_at")))
    return met.select("company_id", "event", "window_start", "articles")


def windows_outside_events(spark, sf_dir):
    """Windows of six hours that start in no labelled period, both ends included."""
    win = feature_windows(articles(spark, sf_dir), "6 hours").select("company_id", "window_start", "articles").withColumn("day", F.to_date("window_start"))
    spans = _in_days(_spans(spark, sf_dir), F.col("opened_at"), F.col("last_seen_at")).toDF("c", "event", "opened_at", "last_seen_at", "d")
    inside = (F.col("company_id") == F.col("c")) & (F.col("day") == F.col("d")) & F.col("window_start").between(F.col("opened_at"), F.col("last_seen_at"))
    return win.join(spans, inside, "left_anti").select("company_id", "window_start", "articles")


def window_at_evidence(spark, sf_dir):
    """For each critical article the latest window of its company that starts at or before
    it. Both sides are put in one order; a window carries on to what comes after it."""
    win = feature_windows(articles(spark, sf_dir), "15 minutes").select("company_id", F.col("window_start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("article_id"), "articles")
    ask = articles(spark, sf_dir).where("negative >= 0.95").select("company_id", F.col("seen_at").alias("at"), F.lit(1).alias("kind"), "article_id", F.lit(None).cast("long").alias("articles"))
    upto = Window.partitionBy("company_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.struct(F.col("at").alias("window_start"), "articles")), ignorenulls=True).over(upto)
    return win.unionByName(ask).withColumn("w", last).where("kind = 1").select("article_id", "w.window_start", "w.articles")


def story_candidates(spark, sf_dir):
    """Pairs of articles of a company and source no more than six hours apart, the earlier
    id first: rows meet in buckets of six hours, those of the next one too."""
    at = F.unix_seconds(F.col("seen_at").cast("timestamp"))
    rows = articles(spark, sf_dir).where("source = 'error'").select("article_id", "company_id", at.alias("at"))
    rows = rows.withColumn("bucket", F.floor(F.col("at") / (HORIZON_HOURS * 3600)))
    other = rows.select("company_id", F.col("article_id").alias("b"), F.col("at").alias("at_b"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    near = rows.withColumnRenamed("article_id", "a").join(other, ["company_id", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("at") - F.col("at_b")) <= HORIZON_HOURS * 3600))
    return near.select("company_id", "a", "b", F.round(F.abs(F.col("at") - F.col("at_b")) / 3600, 6).alias("gap_hours"))


def _norms(spark, sf_dir) -> DataFrame:
    return items(spark, sf_dir).select(F.col("raw_id").alias("id"), "source", "title", T.normalized(F.concat_ws(" ", "title", "summary")).alias("norm"))


def texts_with_terms(spark, sf_dir):
    """Items that hold a term, of one word or more, between other than letters and digits."""
    rows = _norms(spark, sf_dir)
    found = texts_holding(rows, prepared_terms(spark.createDataFrame([(t,) for t in TERMS], "term string")))
    return found.join(rows.select("id", "source"), "id").groupBy("term", "source").agg(F.count(F.lit(1)).alias("items"))


def titles_told_elsewhere(spark, sf_dir):
    """Titles of up to 60 characters that other items' texts hold: how many items, and the first."""
    rows = _norms(spark, sf_dir)
    titles = rows.where("char_length(title) <= 60").select("id", T.normalized(F.col("title")).alias("term"))
    found = texts_holding(rows, prepared_terms(titles)).withColumnRenamed("id", "told_in")
    owners = titles.groupBy("term").agg(F.count(F.lit(1)).alias("owners"), F.min("id").alias("owner"))
    told = found.join(titles.withColumnRenamed("id", "told_in"), ["term", "told_in"], "left_anti")
    return told.join(owners, "term").groupBy("term", "owner", "owners").agg(F.count(F.lit(1)).alias("items"), F.min("told_in").alias("first"))


def json_elements(spark, sf_dir):
    """The companies that a JSON array names, numbers only, with their segment: arrays of
    other kinds and what is no number give no row."""
    i = F.col("o_orderkey")
    doc = F.when(i % 5 == 0, F.lit('{"affected": "none"}')).when(i % 5 == 1, F.lit("[broken")).otherwise(F.format_string('{"affected": [%d, "x", %d]}', F.col("o_custkey"), F.col("o_custkey") + 1))
    each = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.from_json(F.get_json_object(doc, "$.affected"), "array<string>")).alias("e"))
    named = each.select("o_orderkey", F.try_to_number("e", F.lit("9999999999")).cast("long").alias("c_custkey")).where("c_custkey IS NOT NULL")
    return named.join(table(spark, sf_dir, "customer"), "c_custkey").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("o_orderkey").alias("orders"))


def foreign_references(spark, sf_dir):
    """Order lines whose supplier's nation is not that of the order's customer. Lines and
    orders meet in tasks of so many lines, whatever the input, and an order's lines are
    counted there: its number is told apart once, by the task that has all of it."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    tasks = max(1, math.ceil(max(lines.count(), orders.count()) / LINES_A_TASK))
    lines = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey").repartition(tasks, "l_orderkey")
    orders = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey").repartition(tasks, "o_orderkey")
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("s_nationkey <> c_nationkey")
    each = met.groupBy("o_orderkey", "c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("lines"))
    return each.groupBy("c_nationkey", "s_nationkey").agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("orders"))


def articles_in_windows(spark, sf_dir):
    """Per company and day the different articles and negative ones in windows of two or
    more: the counts that a daily row is set to, 0 where there are none."""
    rows = articles(spark, sf_dir)
    win = feature_windows(rows, "15 minutes").where("articles >= 2").select("company_id", "window_start")
    met = rows.withColumn("window_start", F.window("seen_at", "15 minutes")["start"]).join(win, ["company_id", "window_start"], "left_semi")
    counted = met.groupBy("company_id", F.to_date("seen_at").alias("day")).agg(F.countDistinct("article_id").alias("articles"), F.countDistinct(F.when(F.col("label") == "negative", F.col("article_id"))).alias("negative_articles"))
    every = rows.select("company_id", F.to_date("seen_at").alias("day")).distinct()
    return every.join(counted, ["company_id", "day"], "left").na.fill(0)


def risk_articles(spark, sf_dir):
    """Different articles of events that were not dismissed, per company in a period."""
    events = articles(spark, sf_dir).groupBy("company_id", "story").agg(F.max("negative").alias("p"), F.count(F.lit(1)).alias("n")).where((F.col("p") >= 0.85) & (F.col("n") >= 2) & (F.col("story") % 7 != 0))
    rows = articles(spark, sf_dir).where((F.col("seen_at") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("seen_at") < F.lit("2024-01-20").cast("timestamp_ntz")))
    return rows.join(events, ["company_id", "story"], "left_semi").groupBy("company_id").agg(F.countDistinct("article_id").alias("articles"))


def window_attribution(spark, sf_dir):
    """Of each six-hour window: its value, the share of the company's earlier windows that
    are no larger, and the mean of the seven days before."""
    rows = feature_windows(articles(spark, sf_dir), "6 hours").select("company_id", "window_start", F.col("mean_negative").alias("value"))
    rows = rows.withColumn("at", F.unix_seconds(F.col("window_start").cast("timestamp")))
    earlier = Window.partitionBy("company_id").orderBy("at")
    history = F.collect_list("value").over(earlier.rowsBetween(-672, -1))
    base = F.avg("value").over(earlier.rangeBetween(-7 * 86_400, -1))
    below = F.size(F.filter("history", lambda x: x <= F.col("value") + 1e-9))
    return rows.withColumns({"history": history, "base": base}).select("company_id", "window_start", F.round("value", 6).alias("value"), F.round(F.when(F.size("history") > 0, below / F.size("history")), 6).alias("percentile"), F.round("base", 9).alias("baseline"))


QUERIES = {f.__name__: f for f in (windows_of_events, windows_outside_events, window_at_evidence, story_candidates, texts_with_terms, titles_told_elsewhere, json_elements, foreign_references, articles_in_windows, risk_articles, window_attribution)}

_WIN = lambda width: f"{ARTICLES_SQL}, win AS (SELECT company_id, time_bucket(INTERVAL '{width}', seen_at, TIMESTAMP '1970-01-01') AS window_start, count(*) AS articles, avg(negative) AS mean_negative FROM articles GROUP BY ALL)"
_SPANS = f"spans AS (SELECT company_id, event, opened_at, last_seen_at FROM ({SERIES_SQL['hysteresis_events']}) WHERE windows >= 3)"
_NORMS_SQL = ITEMS_SQL + ", n AS (SELECT raw_id, source, title, " + T.normalized_sql("concat_ws(' ', title, summary)") + " AS norm FROM items)"
ORACLE_SQL = {
    "windows_of_events": f"WITH {_WIN('15 minutes')}, {_SPANS} SELECT w.company_id, event, window_start, articles FROM win w JOIN spans s ON w.company_id = s.company_id AND w.window_start BETWEEN s.opened_at AND s.last_seen_at",
    "windows_outside_events": f"WITH {_WIN('6 hours')}, {_SPANS} SELECT company_id, window_start, articles FROM win w WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE w.company_id = s.company_id AND w.window_start BETWEEN s.opened_at AND s.last_seen_at)",
    "window_at_evidence": f"WITH {_WIN('15 minutes')} SELECT article_id, w.window_start, w.articles FROM articles a ASOF LEFT JOIN win w ON a.company_id = w.company_id AND a.seen_at >= w.window_start WHERE negative >= 0.95::DOUBLE",
    "story_candidates": f"""WITH {ARTICLES_SQL}, r AS (SELECT article_id, company_id, floor(epoch(seen_at)) AS sec FROM articles WHERE source = 'error')
      SELECT x.company_id, x.article_id AS a, y.article_id AS b, round(abs(x.sec - y.sec) / 3600, 6) AS gap_hours FROM r x JOIN r y ON x.company_id = y.company_id AND x.article_id < y.article_id AND abs(x.sec - y.sec) <= {HORIZON_HOURS * 3600}""",
    "texts_with_terms": f"WITH {_NORMS_SQL}, t AS (SELECT unnest({TERMS!r}) AS term) SELECT term, source, count(*) AS items FROM n JOIN t ON regexp_matches(norm, '(?:^|[^a-z0-9])' || term || '(?:$|[^a-z0-9])') GROUP BY ALL",
    "titles_told_elsewhere": f"""WITH {_NORMS_SQL}, o AS (SELECT raw_id, {T.normalized_sql('title')} AS term FROM n WHERE length(title) <= 60), t AS (SELECT term, count(*) AS owners, min(raw_id) AS owner, regexp_replace(term, '([.+])', '\\\\\\1', 'g') AS pattern, regexp_matches(term, '{LATIN}') AS latin FROM o WHERE length(term) >= 2 GROUP BY term)
      SELECT t.term, owner, owners, count(*) AS items, min(raw_id) AS first FROM t JOIN n ON contains(norm, t.term) AND (NOT latin OR regexp_matches(norm, '(?:^|[^a-z0-9])' || pattern || '(?:$|[^a-z0-9])')) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.raw_id = n.raw_id AND o.term = t.term) GROUP BY ALL""",
    "json_elements": """WITH e AS (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) AS c_custkey FROM orders WHERE o_orderkey % 5 > 1) SELECT c_mktsegment, count(*) AS links, count(DISTINCT o_orderkey) AS orders FROM e JOIN customer USING (c_custkey) GROUP BY 1""",
    "foreign_references": """SELECT c_nationkey, s_nationkey, count(*) AS lines, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL""",
    "articles_in_windows": f"""WITH {_WIN('15 minutes')} SELECT a.company_id, CAST(seen_at AS DATE) AS day, count(DISTINCT article_id) FILTER (WHERE articles >= 2) AS articles, count(DISTINCT article_id) FILTER (WHERE articles >= 2 AND label = 'negative') AS negative_articles
      FROM articles a JOIN win w ON a.company_id = w.company_id AND w.window_start = time_bucket(INTERVAL 15 MINUTES, seen_at, TIMESTAMP '1970-01-01') GROUP BY ALL""",
    "risk_articles": f"""WITH {ARTICLES_SQL}, e AS (SELECT company_id, story FROM articles WHERE story % 7 <> 0 GROUP BY ALL HAVING max(negative) >= 0.85::DOUBLE AND count(*) >= 2) SELECT company_id, count(DISTINCT article_id) AS articles FROM articles SEMI JOIN e USING (company_id, story) WHERE seen_at >= TIMESTAMP '2024-01-10' AND seen_at < TIMESTAMP '2024-01-20' GROUP BY 1""",
    "window_attribution": f"""WITH {_WIN('6 hours')}, r AS (SELECT company_id, window_start, mean_negative AS value FROM win), h AS (SELECT *, list(value) OVER (PARTITION BY company_id ORDER BY window_start ROWS BETWEEN 672 PRECEDING AND 1 PRECEDING) AS hist, avg(value) OVER (PARTITION BY company_id ORDER BY window_start RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS base FROM r)
      SELECT company_id, window_start, round(value, 6) AS value, round(CASE WHEN len(hist) > 0 THEN len(list_filter(hist, lambda x: x <= value + 1e-9::DOUBLE)) / len(hist) END, 6) AS percentile, round(base, 9) AS baseline FROM h""",
}
