"""Windows over time: feature windows, deltas, robust z, streaks, events, drift."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions.scalar import median_of, with_robust_z
from tidewatch.sources.tables import ARTICLES_SQL, ATTEMPTS_SQL, articles, attempts

OPEN_AT, CRITICAL_AT, CLOSE_BELOW, GAP_SECONDS = 0.65, 0.85, 0.45, 1800


def feature_windows(rows, width: str):
    """Per company and tumbling window: counts, stories, amplification, sentiment."""
    grouped = rows.groupBy("company_id", F.window("seen_at", width).alias("w")).agg(
        F.count(F.lit(1)).alias("articles"), F.countDistinct("story").alias("stories"), F.countDistinct("source").alias("sources"), F.countDistinct(F.when(F.col("source") == "error", F.col("source"))).alias("failed_sources"),
        F.avg("negative").alias("mean_negative"), F.percentile("negative", 0.9).alias("p90_negative"), F.max("negative").alias("max_negative"),
    )
    return grouped.select("company_id", F.col("w.start").alias("window_start"), "articles", "stories", (F.col("articles") - F.col("stories")).alias("amplification"), "sources", "failed_sources", "mean_negative", "p90_negative", "max_negative")


def feature_window_15m(spark, sf_dir):
    rows = with_quality(feature_windows(articles(spark, sf_dir), "15 minutes"))
    return rows.select(*[F.round(c, 6).alias(c) if c.endswith("negative") else c for c in rows.columns])


def window_delta(spark, sf_dir):
    """Change of counts against the company's previous stored window, 0 before the first."""
    rows = feature_windows(articles(spark, sf_dir), "6 hours")
    before = Window.partitionBy("company_id").orderBy("window_start")
    return rows.select("company_id", "window_start", (F.col("articles") - F.coalesce(F.lag("articles").over(before), F.lit(0))).alias("article_delta"), (F.col("stories") - F.coalesce(F.lag("stories").over(before), F.lit(0))).alias("story_delta"))


def with_quality(rows):
    """Windows with their data quality: by the sources that spoke, errors apart."""
    return rows.withColumn("quality", F.when(F.col("sources") == F.col("failed_sources"), "unavailable").when(F.col("failed_sources") > 0, "partial").otherwise("complete"))


def window_robust_z(spark, sf_dir):
    """Robust z of a window's articles over up to 672 earlier windows of its company that
    are not unavailable. The frame counts such windows only."""
    rows = with_quality(feature_windows(articles(spark, sf_dir), "6 hours"))
    of = Window.partitionBy("company_id")
    usable = F.col("quality") != "unavailable"
    rows = rows.withColumn("before", F.coalesce(F.sum(usable.cast("long")).over(of.orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    history = F.collect_list(F.when(usable, F.col("articles").cast("double"))).over(of.orderBy("before").rangeBetween(-672, -1))
    return with_robust_z(rows.withColumn("history", history), "articles", "history").select("company_id", "window_start", "quality", F.round("z", 6).alias("z"))


def source_streak(spark, sf_dir):
    """Distinct failed slots since the last success, newest first, per company and source."""
    newest = Window.partitionBy("company_id", "source").orderBy(F.desc("slot"), F.desc("attempt_id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = attempts(spark, sf_dir).withColumn("successes", F.sum(F.col("succeeded").cast("int")).over(newest))
    return rows.groupBy("company_id", "source").agg(F.countDistinct(F.when(F.col("successes") == 0, F.col("slot"))).alias("streak"), F.max(F.when(F.col("succeeded"), F.col("slot"))).alias("last_success"))


def eligible_at(spark, sf_dir):
    """When a story reached its second article."""
    order = Window.partitionBy("company_id", "story").orderBy("seen_at", "article_id")
    return articles(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n = 2").select("company_id", "story", F.col("seen_at").alias("eligible_at"))


def hysteresis_events(spark, sf_dir):
    """Risk events from windows. A risky window goes to the open event whose last risky
    window ended no more than the gap before it starts, or opens one. Windows that are
    not risky count as low or reset the count; two low ones in a row, whatever other
    events do, close an event at the end of the second. An event that was critical
    stays so. A company has at most 96 windows a day, which bounds its sort."""
    rows = feature_windows(articles(spark, sf_dir), "15 minutes").select("company_id", "window_start", "max_negative")
    rows = rows.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 15 MINUTES"))
    order = Window.partitionBy("company_id").orderBy("window_start")
    risky, low = F.col("max_negative") >= OPEN_AT, F.col("max_negative") < CLOSE_BELOW
    rows = rows.withColumn("lows", F.sum(low.cast("int")).over(order))
    calm = rows.where(~risky).withColumn("pair_from", F.when(low & (F.lag("max_negative").over(order) < CLOSE_BELOW), F.lag("window_start").over(order)))
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    gap = seconds(F.col("window_start")) - seconds(F.lag("window_end").over(order))
    new = F.coalesce((gap > GAP_SECONDS) | (F.col("lows") - F.lag("lows").over(order) >= 2), F.lit(True))
    numbered = rows.where(risky).withColumn("event", F.sum(new.cast("int")).over(order))
    events = numbered.groupBy("company_id", "event").agg(F.min("window_start").alias("opened_at"), F.max("window_end").alias("last_seen_at"), F.count(F.lit(1)).alias("windows"), F.max("max_negative").alias("peak"))
    pairs = calm.where("pair_from IS NOT NULL").select("company_id", F.col("pair_from").alias("at"), F.lit(1).alias("pair"), "window_end", F.lit(None).cast("long").alias("event"))
    seen = events.select("company_id", F.col("last_seen_at").alias("at"), F.lit(0).alias("pair"), F.lit(None).cast("timestamp_ntz").alias("window_end"), "event")
    after = Window.partitionBy("company_id").orderBy("at", "pair").rowsBetween(0, Window.unboundedFollowing)
    closed = pairs.unionByName(seen).withColumn("closed_at", F.first("window_end", ignorenulls=True).over(after)).where("event IS NOT NULL").select("company_id", "event", "closed_at")
    return events.join(closed, ["company_id", "event"]).select("company_id", "event", "opened_at", "last_seen_at", "windows", F.round("peak", 6).alias("peak"), F.when(F.col("peak") >= CRITICAL_AT, "critical").otherwise("warning").alias("severity"), "closed_at")


def session_gaps(spark, sf_dir):
    """Sessions of a company's articles, at most thirty minutes between two."""
    rows = articles(spark, sf_dir).groupBy("company_id", F.session_window("seen_at", "30 minutes").alias("s")).agg(F.count(F.lit(1)).alias("articles"))
    return rows.select("company_id", F.col("s.start").alias("started_at"), "articles")


def inactivity_close(spark, sf_dir):
    """Stories closed for lack of evidence: closed at midnight four days after the last day."""
    rows = articles(spark, sf_dir).groupBy("company_id", "story").agg(F.max("seen_at").alias("last_at"))
    cutoff = F.date_sub(F.lit("2024-01-28").cast("date"), 3)
    closes = F.date_add(F.to_date("last_at"), 4)
    return rows.select("company_id", "story", (F.to_date("last_at") < cutoff).alias("closed"), F.when(F.to_date("last_at") < cutoff, closes).alias("closed_on"))


def empirical_cdf(spark, sf_dir):
    """Share of all values of a source that are no larger."""
    return articles(spark, sf_dir).select("article_id", F.round(F.cume_dist().over(Window.partitionBy("source").orderBy("negative")), 6).alias("cdf"))


def with_robust_shift(df, recent: str, baseline: str, name: str = "shift"):
    """df with the shift of the median of one array against another in robust deviations:
    null with fewer than 8 and 40 values; without spread the raw quartiles, then 1,
    measure it. Step by step, so that no step repeats another."""
    n, at = F.size(baseline), lambda q: F.try_element_at("__sorted", F.greatest(F.floor((F.size(baseline) - 1) * F.lit(q)) + 1, F.lit(1)).cast("int"))
    steps = df.withColumns({"__now": median_of(F.col(recent)), "__base": median_of(F.col(baseline)), "__sorted": F.array_sort(baseline)})
    steps = steps.withColumn("__mad", median_of(F.transform(baseline, lambda x: F.abs(x - F.col("__base")))) * 1.4826)
    steps = steps.withColumn("__iqr", at(0.75) - at(0.25))
    spread = F.when(F.col("__mad") >= 1e-9, F.col("__mad")).when(F.col("__iqr") >= 1e-9, F.col("__iqr")).otherwise(1.0)
    shift = F.when((F.size(recent) >= 8) & (n >= 40), F.abs(F.col("__now") - F.col("__base")) / spread)
    return steps.withColumn(name, shift).drop("__now", "__base", "__sorted", "__mad", "__iqr")


def drift_shift(spark, sf_dir):
    """Shift of seven features of each company's windows of the last ten days against the
    usable windows before; 3.5 deviations and more are a drift."""
    rows = with_quality(feature_windows(articles(spark, sf_dir), "6 hours")).withColumn("recent", F.to_date("window_start") >= F.lit("2024-01-21").cast("date"))
    names = ["articles", "stories", "amplification", "sources", "mean_negative", "p90_negative", "max_negative"]
    long = rows.select("company_id", "recent", "quality", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])).alias("f")).select("company_id", "recent", "quality", "f.*")
    both = long.groupBy("company_id", "feature").agg(F.collect_list(F.when(F.col("recent"), F.col("value"))).alias("now"), F.collect_list(F.when(~F.col("recent") & (F.col("quality") != "unavailable"), F.col("value"))).alias("base"))
    return with_robust_shift(both, "now", "base").withColumn("shift", F.round("shift", 6)).select("company_id", "feature", "shift", (F.col("shift") >= 3.5).alias("drifts"))


def daily_rollup(spark, sf_dir):
    """Days from windows: sums of counts, largest number of sources, mean of means, and
    windows of each quality."""
    rows = with_quality(feature_windows(articles(spark, sf_dir), "15 minutes")).withColumn("day", F.to_date("window_start"))
    of = lambda q: F.count_if(F.col("quality") == q).alias(q)
    return rows.groupBy("company_id", "day").agg(of("complete"), of("partial"), of("unavailable"), F.sum("articles").alias("articles"), F.max("sources").alias("sources"), F.round(F.avg("mean_negative"), 8).alias("mean_negative"))


QUERIES = {f.__name__: f for f in (feature_window_15m, window_delta, window_robust_z, source_streak, eligible_at, hysteresis_events, session_gaps, inactivity_close, empirical_cdf, drift_shift, daily_rollup)}


def _windows(width: str) -> str:
    return f"""{ARTICLES_SQL}, win AS (SELECT company_id, time_bucket(INTERVAL '{width}', seen_at, TIMESTAMP '1970-01-01') AS window_start, count(*) AS articles, count(DISTINCT story) AS stories, count(*) - count(DISTINCT story) AS amplification,
      count(DISTINCT source) AS sources, count(DISTINCT source) FILTER (WHERE source = 'error') AS failed_sources, CASE WHEN count(*) FILTER (WHERE source <> 'error') = 0 THEN 'unavailable' WHEN count(*) FILTER (WHERE source = 'error') > 0 THEN 'partial' ELSE 'complete' END AS quality, avg(negative) AS mean_negative, quantile_cont(negative, 0.9) AS p90_negative, max(negative) AS max_negative FROM articles GROUP BY ALL)"""


ORACLE_SQL = {
    "feature_window_15m": f"WITH {_windows('15 minutes')} SELECT company_id, window_start, articles, stories, amplification, sources, failed_sources, quality, round(mean_negative, 6) AS mean_negative, round(p90_negative, 6) AS p90_negative, round(max_negative, 6) AS max_negative FROM win",
    "window_delta": f"""WITH {_windows('6 hours')} SELECT company_id, window_start, articles - coalesce(lag(articles) OVER w, 0) AS article_delta, stories - coalesce(lag(stories) OVER w, 0) AS story_delta FROM win WINDOW w AS (PARTITION BY company_id ORDER BY window_start)""",
    "window_robust_z": f"""WITH {_windows('6 hours')}, b AS (SELECT *, coalesce(sum((quality <> 'unavailable')::INT) OVER (PARTITION BY company_id ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM win),
      h AS (SELECT *, list_filter(list(CASE WHEN quality <> 'unavailable' THEN CAST(articles AS DOUBLE) END) OVER (PARTITION BY company_id ORDER BY before RANGE BETWEEN 672 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS hist FROM b),
      m AS (SELECT *, list_median(hist) AS med FROM h), s AS (SELECT *, 1.4826 * list_median(list_transform(hist, lambda x: abs(x - med))) AS mad, (list_aggregate(hist, 'quantile_cont', 0.75) - list_aggregate(hist, 'quantile_cont', 0.25)) / 1.349 AS iqr FROM m),
      t AS (SELECT *, CASE WHEN mad < 1e-9 THEN iqr ELSE mad END AS spread FROM s)
      SELECT company_id, window_start, quality, round(CASE WHEN coalesce(len(hist), 0) < 8 THEN 0.0 WHEN spread < 1e-9 THEN CASE WHEN abs(articles - med) < 1e-9 THEN 0.0 ELSE sign(articles - med) * 10.0 END ELSE greatest(least((articles - med) / spread, 20.0), -20.0) END, 6) AS z FROM t""",
    "source_streak": f"""WITH {ATTEMPTS_SQL}, r AS (SELECT *, sum(succeeded::INT) OVER (PARTITION BY company_id, source ORDER BY slot DESC, attempt_id DESC ROWS UNBOUNDED PRECEDING) AS ok FROM attempts)
      SELECT company_id, source, count(DISTINCT slot) FILTER (WHERE ok = 0) AS streak, max(slot) FILTER (WHERE succeeded) AS last_success FROM r GROUP BY ALL""",
    "eligible_at": f"WITH {ARTICLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY company_id, story ORDER BY seen_at, article_id) AS n FROM articles) SELECT company_id, story, seen_at AS eligible_at FROM r WHERE n = 2",
    "hysteresis_events": f"""WITH {_windows('15 minutes')}, l AS (SELECT *, window_start + INTERVAL 15 MINUTES AS window_end, sum((max_negative < {CLOSE_BELOW}::DOUBLE)::INT) OVER (PARTITION BY company_id ORDER BY window_start) AS lows FROM win),
      c AS (SELECT company_id, window_end, CASE WHEN max_negative < {CLOSE_BELOW}::DOUBLE AND lag(max_negative) OVER w < {CLOSE_BELOW}::DOUBLE THEN lag(window_start) OVER w END AS pair_from FROM l WHERE max_negative < {OPEN_AT}::DOUBLE WINDOW w AS (PARTITION BY company_id ORDER BY window_start)),
      n AS (SELECT *, coalesce(epoch(window_start) - epoch(lag(window_end) OVER w) > {GAP_SECONDS} OR lows - lag(lows) OVER w >= 2, TRUE)::INT AS is_new FROM l WHERE max_negative >= {OPEN_AT}::DOUBLE WINDOW w AS (PARTITION BY company_id ORDER BY window_start)),
      e AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY company_id ORDER BY window_start) AS BIGINT) AS event FROM n),
      g AS (SELECT company_id, event, min(window_start) AS opened_at, max(window_end) AS last_seen_at, count(*) AS windows, max(max_negative) AS peak FROM e GROUP BY company_id, event)
      SELECT company_id, event, opened_at, last_seen_at, windows, round(peak, 6) AS peak, CASE WHEN peak >= {CRITICAL_AT}::DOUBLE THEN 'critical' ELSE 'warning' END AS severity, (SELECT min(c.window_end) FROM c WHERE c.company_id = g.company_id AND c.pair_from >= g.last_seen_at) AS closed_at FROM g""",
    "session_gaps": f"""WITH {ARTICLES_SQL}, g AS (SELECT *, (seen_at >= lag(seen_at) OVER w + INTERVAL 30 MINUTES)::INT AS gap FROM articles WINDOW w AS (PARTITION BY company_id ORDER BY seen_at, article_id)),
      s AS (SELECT *, sum(coalesce(gap, 1)) OVER (PARTITION BY company_id ORDER BY seen_at, article_id) AS n FROM g) SELECT company_id, min(seen_at) AS started_at, count(*) AS articles FROM s GROUP BY company_id, n""",
    "inactivity_close": f"""WITH {ARTICLES_SQL}, s AS (SELECT company_id, story, CAST(max(seen_at) AS DATE) AS d FROM articles GROUP BY ALL)
      SELECT company_id, story, d < DATE '2024-01-25' AS closed, CASE WHEN d < DATE '2024-01-25' THEN CAST(d + 4 AS DATE) END AS closed_on FROM s""",
    "empirical_cdf": f"WITH {ARTICLES_SQL} SELECT article_id, round(cume_dist() OVER (PARTITION BY source ORDER BY negative), 6) AS cdf FROM articles",
    "drift_shift": f"""WITH {_windows('6 hours')}, u AS (UNPIVOT (SELECT company_id, quality, CAST(window_start AS DATE) >= DATE '2024-01-21' AS recent, articles::DOUBLE AS articles, stories::DOUBLE AS stories, amplification::DOUBLE AS amplification, sources::DOUBLE AS sources, mean_negative::DOUBLE AS mean_negative, p90_negative::DOUBLE AS p90_negative, max_negative::DOUBLE AS max_negative FROM win) ON articles, stories, amplification, sources, mean_negative, p90_negative, max_negative INTO NAME feature VALUE value),
      b AS (SELECT company_id, feature, coalesce(list(value) FILTER (WHERE recent), []) AS now, coalesce(list_sort(list(value) FILTER (WHERE NOT recent AND quality <> 'unavailable')), []) AS base FROM u GROUP BY ALL), m AS (SELECT *, list_median(base) AS mid FROM b), d AS (SELECT *, 1.4826::DOUBLE * list_median(list_transform(base, lambda x: abs(x - mid))) AS mad, base[CAST(floor((len(base) - 1) * 0.75::DOUBLE) AS BIGINT) + 1] - base[CAST(floor((len(base) - 1) * 0.25::DOUBLE) AS BIGINT) + 1] AS iqr FROM m),
      s AS (SELECT company_id, feature, round(CASE WHEN len(now) >= 8 AND len(base) >= 40 THEN abs(list_median(now) - mid) / CASE WHEN mad >= 1e-9 THEN mad WHEN iqr >= 1e-9 THEN iqr ELSE 1.0::DOUBLE END END, 6) AS shift FROM d) SELECT *, shift >= 3.5::DOUBLE AS drifts FROM s""",
    "daily_rollup": f"""WITH {_windows('15 minutes')} SELECT company_id, CAST(window_start AS DATE) AS day, count(*) FILTER (WHERE quality = 'complete') AS complete, count(*) FILTER (WHERE quality = 'partial') AS partial, count(*) FILTER (WHERE quality = 'unavailable') AS unavailable, CAST(sum(articles) AS BIGINT) AS articles, max(sources) AS sources, round(avg(mean_negative), 8) AS mean_negative FROM win GROUP BY ALL""",
}
