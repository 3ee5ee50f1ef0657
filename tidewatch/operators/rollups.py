"""Dashboard roll-ups: grouped, filtered and distinct aggregates, HAVING, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.sources.tables import ARTICLES_SQL, ATTEMPTS_SQL, FILTERS_SQL, articles, attempts, filter_results, table


def dashboard_daily(spark, sf_dir):
    """Articles, negative ones and distinct stories by day, days without any as 0."""
    rows = articles(spark, sf_dir).withColumn("day", F.to_date("seen_at"))
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("label") == "negative").alias("negative_articles"), F.countDistinct("company_id", "story").alias("stories"))
    span = rows.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return span.join(days, "day", "left").na.fill(0)


def dashboard_totals_filter(spark, sf_dir):
    """Totals with and without conditions, in one pass."""
    return articles(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"), F.count("published_at").alias("published"), F.count_if(F.col("label") == "negative").alias("negative"),
        F.countDistinct(F.when(F.col("negative") >= 0.85, F.col("company_id"))).alias("critical_companies"), F.round(F.avg("negative"), 6).alias("mean_negative"),
    )


def company_correlated_counts(spark, sf_dir):
    """Per company its articles and its stories of two or more, each pre-aggregated."""
    rows = articles(spark, sf_dir)
    n = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("articles"), F.max("seen_at").alias("last_at"))
    stories = rows.groupBy("company_id", "story").count().where("count >= 2").groupBy("company_id").agg(F.count(F.lit(1)).alias("stories"))
    return n.join(stories, "company_id", "left").na.fill(0, ["stories"])


def latest_filter_result(spark, sf_dir):
    """The newest decision of each raw article."""
    newest = filter_results(spark, sf_dir).groupBy("raw_id").agg(F.max_by(F.struct("decision", "status", "filtered_at"), "version").alias("x"))
    return newest.select("raw_id", "x.*")


def filter_summary(spark, sf_dir):
    """Newest decisions by decision and status, with mean age in hours and share."""
    rows = latest_filter_result(spark, sf_dir)
    now = F.lit("2000-01-01").cast("timestamp_ntz")
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("filtered_at").cast("timestamp"))) / 3600
    return rows.groupBy("decision", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(age), 6).alias("mean_age_hours"))


def eligible_having(spark, sf_dir):
    """Stories of two or more distinct articles whose last one falls in a period."""
    grouped = articles(spark, sf_dir).groupBy("company_id", "story").agg(F.countDistinct("article_id").alias("articles"), F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at"))
    return grouped.where((F.col("articles") >= 2) & F.col("last_at").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")))


def story_sentiment(spark, sf_dir):
    """A story's sentiment by the means of three probabilities: an article's own, or else
    1 or 0 by its label, or else none. The one strictly ahead wins, neutral if none is;
    a story without any value of one kind is pending."""
    i, rest = F.col("article_id"), 1 - F.col("negative")
    told = {"negative": F.col("negative"), "neutral": rest * 0.4, "positive": rest * 0.6}
    label = F.when(i % 8 != 0, F.col("label"))
    value = {k: F.when(i % 4 != 0, v).when(label == k, 1.0).when(label.isNotNull(), 0.0) for k, v in told.items()}
    rows = articles(spark, sf_dir).groupBy("company_id", "story").agg(*[F.avg(v).alias(k) for k, v in value.items()])
    ahead = lambda a, b, c: (F.col(a) > F.col(b)) & (F.col(a) > F.col(c))
    missing = F.col("negative").isNull() | F.col("neutral").isNull() | F.col("positive").isNull()
    state = F.when(missing, "pending").when(ahead("negative", "neutral", "positive"), "negative").when(ahead("positive", "neutral", "negative"), "positive").otherwise("neutral")
    return rows.select("company_id", "story", state.alias("sentiment"))


def source_concentration(spark, sf_dir):
    """Largest share of one source, and number of sources over articles, per company."""
    by = articles(spark, sf_dir).groupBy("company_id", "source").count()
    return by.groupBy("company_id").agg(F.round(F.max("count") / F.sum("count"), 6).alias("concentration"), F.round(F.count(F.lit(1)) / F.sum("count"), 6).alias("diversity"), F.max_by("source", F.struct("count", "source")).alias("main_source"))


def label_counts_zero_filled(spark, sf_dir):
    """Counts for a fixed list of labels, absent ones as 0."""
    labels = spark.createDataFrame([(x,) for x in ("negative", "neutral", "positive", "unknown")], "label string")
    return labels.join(articles(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").na.fill(0, ["n"])


def json_group(spark, sf_dir):
    """Articles grouped by a JSON field."""
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def attempt_coverage(spark, sf_dir):
    """Per company and source: attempts, successes, quality of the collection."""
    n, ok = F.count(F.lit(1)), F.count_if("succeeded")
    quality = F.when(ok == n, "complete").when(ok > 0, "partial").otherwise("unavailable")
    return attempts(spark, sf_dir).groupBy("company_id", "source").agg(n.alias("attempts"), ok.alias("successes"), quality.alias("quality"))


def decimal_revenue(spark, sf_dir):
    """Money in exact decimals, by flag and status."""
    money = F.col("l_extendedprice").cast("decimal(20,2)")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(money).cast("decimal(30,2)").alias("revenue"), F.count(F.lit(1)).alias("n"))
    return rows


def hierarchy_rollup(spark, sf_dir):
    """Customers and balances of each region and nation, parents included."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def duplicate_keys(spark, sf_dir):
    """Natural keys that occur more than once."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


#: Row digests in one piece of a company's joined text.
PIECE_ROWS = 64


def _pieces(batches):
    """Sorted (company_id, h) to pieces of the joined digests, numbered in order."""
    from itertools import groupby

    import pyarrow as pa
    from pyspark import TaskContext

    part, piece = TaskContext.get().partitionId(), 0
    for batch in batches:
        companies, pieces, numbers = [], [], []
        for company, pairs in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda x: x[0]):
            hashes = [h for _, h in pairs]
            for i in range(0, len(hashes), PIECE_ROWS):
                companies.append(company)
                pieces.append(",".join(hashes[i : i + PIECE_ROWS]))
                numbers.append(piece)
                piece += 1
        yield pa.RecordBatch.from_arrays([pa.array(companies, batch.schema.types[0]), pa.array([part] * len(pieces), pa.int32()), pa.array(numbers, pa.int64()), pa.array(pieces, pa.string())], names=["company_id", "part", "number", "piece"])


def _digests(batches):
    """Pieces in order of company and number to one digest a company."""
    import hashlib

    import pyarrow as pa

    kind, company, state = None, None, None
    for batch in batches:
        kind, companies, digests = batch.schema.types[0], [], []
        for key, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if state is not None and key == company:
                state.update(b",")
            else:
                if state is not None:
                    companies.append(company)
                    digests.append(state.hexdigest())
                company, state = key, hashlib.sha256()
            state.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(companies, kind), pa.array(digests, pa.string())], names=["company_id", "digest"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([company], kind), pa.array([state.hexdigest()], pa.string())], names=["company_id", "digest"])


def row_set_checksum(spark, sf_dir):
    """A digest of each company's set of articles, whatever their order. The rows'
    digests are sorted by range partitions and reach the company's digest in pieces, so
    no value and no task's memory grows with the articles of a company."""
    each = F.sha2(F.concat_ws("|", "article_id", "source", "label"), 256)
    rows = articles(spark, sf_dir).select("company_id", each.alias("h"))
    company = f"company_id {dict(rows.dtypes)['company_id']}"
    pieces = rows.repartitionByRange("company_id", "h").sortWithinPartitions("company_id", "h").mapInArrow(_pieces, f"{company}, part int, number long, piece string")
    ordered = pieces.repartition("company_id").sortWithinPartitions("company_id", "part", "number").select("company_id", "piece")
    return ordered.mapInArrow(_digests, f"{company}, digest string")


QUERIES = {f.__name__: f for f in (dashboard_daily, dashboard_totals_filter, company_correlated_counts, latest_filter_result, filter_summary, eligible_having, story_sentiment, source_concentration, label_counts_zero_filled, json_group, attempt_coverage, decimal_revenue, hierarchy_rollup, duplicate_keys, row_set_checksum)}

ORACLE_SQL = {
    "dashboard_daily": f"""WITH {ARTICLES_SQL}, d AS (SELECT CAST(seen_at AS DATE) AS day, * FROM articles),
      g AS (SELECT day, count(*) AS articles, count(*) FILTER (WHERE label = 'negative') AS negative_articles, count(DISTINCT (company_id, story)) AS stories FROM d GROUP BY day),
      c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS DATE) AS day)
      SELECT c.day, coalesce(articles, 0) AS articles, coalesce(negative_articles, 0) AS negative_articles, coalesce(stories, 0) AS stories FROM c LEFT JOIN g USING (day)""",
    "dashboard_totals_filter": f"""WITH {ARTICLES_SQL} SELECT count(*) AS total, count(published_at) AS published, count(*) FILTER (WHERE label = 'negative') AS negative,
      count(DISTINCT company_id) FILTER (WHERE negative >= 0.85) AS critical_companies, round(avg(negative), 6) AS mean_negative FROM articles""",
    "company_correlated_counts": f"""WITH {ARTICLES_SQL} SELECT company_id, count(*) AS articles, max(seen_at) AS last_at,
      (SELECT count(*) FROM (SELECT b.story FROM articles b WHERE b.company_id = a.company_id GROUP BY b.story HAVING count(*) >= 2)) AS stories FROM articles a GROUP BY company_id""",
    "latest_filter_result": f"WITH {FILTERS_SQL} SELECT raw_id, decision, status, filtered_at FROM filters WHERE newest = 1",
    "filter_summary": f"""WITH {FILTERS_SQL} SELECT decision, status, count(*) AS n, round(avg((epoch(TIMESTAMP '2000-01-01') - epoch(filtered_at)) / 3600), 6) AS mean_age_hours
      FROM filters WHERE newest = 1 GROUP BY ALL""",
    "eligible_having": f"""WITH {ARTICLES_SQL} SELECT company_id, story, count(DISTINCT article_id) AS articles, min(seen_at) AS first_at, max(seen_at) AS last_at FROM articles GROUP BY company_id, story
      HAVING count(DISTINCT article_id) >= 2 AND max(seen_at) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""",
    "story_sentiment": f"""WITH {ARTICLES_SQL}, v AS (SELECT company_id, story, CASE WHEN article_id % 4 <> 0 THEN negative WHEN article_id % 8 <> 0 THEN (label = 'negative')::INT END AS n, CASE WHEN article_id % 4 <> 0 THEN (1 - negative) * 0.4::DOUBLE WHEN article_id % 8 <> 0 THEN (label = 'neutral')::INT END AS u, CASE WHEN article_id % 4 <> 0 THEN (1 - negative) * 0.6::DOUBLE WHEN article_id % 8 <> 0 THEN (label = 'positive')::INT END AS p FROM articles),
      a AS (SELECT company_id, story, avg(n) AS n, avg(u) AS u, avg(p) AS p FROM v GROUP BY ALL) SELECT company_id, story, CASE WHEN n IS NULL OR u IS NULL OR p IS NULL THEN 'pending' WHEN n > u AND n > p THEN 'negative' WHEN p > u AND p > n THEN 'positive' ELSE 'neutral' END AS sentiment FROM a""",
    "source_concentration": f"""WITH {ARTICLES_SQL}, s AS (SELECT company_id, source, count(*) AS n FROM articles GROUP BY ALL)
      SELECT company_id, round(max(n) / sum(n), 6) AS concentration, round(count(*) / sum(n), 6) AS diversity, arg_max(source, (n, source)) AS main_source FROM s GROUP BY company_id""",
    "label_counts_zero_filled": f"""WITH {ARTICLES_SQL} SELECT l.label, count(a.article_id) AS n FROM (VALUES ('negative'), ('neutral'), ('positive'), ('unknown')) l(label) LEFT JOIN articles a ON a.label = l.label GROUP BY l.label""",
    "json_group": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "attempt_coverage": f"""WITH {ATTEMPTS_SQL} SELECT company_id, source, count(*) AS attempts, count(*) FILTER (WHERE succeeded) AS successes,
      CASE WHEN bool_and(succeeded) THEN 'complete' WHEN bool_or(succeeded) THEN 'partial' ELSE 'unavailable' END AS quality FROM attempts GROUP BY ALL""",
    "decimal_revenue": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(20,2))) AS DECIMAL(30,2)) AS revenue, count(*) AS n FROM lineitem GROUP BY ALL",
    "hierarchy_rollup": """SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "row_set_checksum": f"""WITH {ARTICLES_SQL}, e AS (SELECT company_id, sha256(concat_ws('|', article_id, source, label)) AS h FROM articles)
      SELECT company_id, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM e GROUP BY company_id""",
}
