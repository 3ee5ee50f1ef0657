"""Joins, set operations, top-k and sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.sources.tables import ARTICLES_SQL, FILTERS_SQL, articles, filter_results, table


def anti_unlabelled(spark, sf_dir):
    """Documents that nobody has labelled."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def semi_exists(spark, sf_dir):
    """Orders that have an accepted filter result."""
    accepted = filter_results(spark, sf_dir).where("decision = 'A'")
    return table(spark, sf_dir, "orders").join(accepted, F.col("o_orderkey") == F.col("raw_id"), "left_semi").select("o_orderkey", "o_orderstatus")


def not_in_non_risk(spark, sf_dir):
    """Stories that hold no critical article (NOT IN, null-safe by construction)."""
    rows = articles(spark, sf_dir)
    critical = rows.where("negative >= 0.85").select("company_id", "story").where("story is not null")
    return rows.select("company_id", "story").distinct().join(critical, ["company_id", "story"], "left_anti")


def union_of_ids(spark, sf_dir):
    """Ids of raw articles whose newest decision is accepted, or that were ever reviewed."""
    rows = filter_results(spark, sf_dir)
    newest = rows.groupBy("raw_id").agg(F.max_by("decision", "version").alias("decision")).where("decision = 'A'").select("raw_id")
    return newest.union(rows.where("decision = 'R' and status = 'F'").select("raw_id")).distinct()


def labelled_pairs(spark, sf_dir):
    """Agreement of two annotators: a company's sources compared by mean label."""
    rows = articles(spark, sf_dir).groupBy("company_id", "source").agg(F.avg((F.col("label") == "negative").cast("double")).alias("share"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.company_id") == F.col("b.company_id")) & (F.col("a.source") < F.col("b.source")))
    return pairs.groupBy(F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("a.share") >= 0.34) == (F.col("b.share") >= 0.34)).cast("double")), 6).alias("agreement"))


def range_join_windows(spark, sf_dir):
    """Articles within two hours after an error of their company: both sides meet in
    two-hour buckets, so the range is an equi-join with a condition."""
    rows, width = articles(spark, sf_dir), 7200
    seconds = F.unix_seconds(F.col("seen_at").cast("timestamp"))
    left = rows.where("source = 'error'").select("company_id", F.col("article_id").alias("error_id"), seconds.alias("from_s"))
    left = left.withColumn("bucket", F.explode(F.array(F.floor(F.col("from_s") / width), F.floor(F.col("from_s") / width) + 1)))
    right = rows.where("source = 'purchase'").select("company_id", "article_id", seconds.alias("at_s"), F.floor(seconds / width).alias("bucket"))
    met = left.join(right, ["company_id", "bucket"]).where((F.col("at_s") > F.col("from_s")) & (F.col("at_s") <= F.col("from_s") + width))
    return met.groupBy("error_id").agg(F.count(F.lit(1)).alias("purchases"))


def asof_previous(spark, sf_dir):
    """For each purchase the newest view of its company before it: a union in order
    of time and the last value seen, no pair of rows."""
    rows = articles(spark, sf_dir).where("source in ('view', 'purchase')")
    order = Window.partitionBy("company_id").orderBy("seen_at", F.col("source") == "view", "article_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("view_id", F.last(F.when(F.col("source") == "view", F.col("article_id")), True).over(order))
    return seen.where("source = 'purchase'").select("article_id", "company_id", "view_id")


def topk_evidence(spark, sf_dir):
    """The three most negative articles of each company, newest first among equals."""
    best = Window.partitionBy("company_id").orderBy(F.desc("negative"), F.desc("seen_at"), "article_id")
    ranked = articles(spark, sf_dir).withColumn("rank", F.row_number().over(best).cast("long")).where("rank <= 3")
    return ranked.select("company_id", "rank", "article_id", F.round("negative", 6).alias("negative"))


def stratified_cells(spark, sf_dir):
    """Up to five articles of each source and label, in an order by hash."""
    cell = Window.partitionBy("source", "label").orderBy(F.md5(F.concat(F.lit("seed"), F.col("article_id").cast("string"))))
    return articles(spark, sf_dir).withColumn("rank", F.row_number().over(cell)).where("rank <= 5").select("source", "label", "article_id")


def hash_sample(spark, sf_dir):
    """One hundred stories, the same in every run."""
    rows = articles(spark, sf_dir).select("company_id", "story").distinct()
    return rows.withColumn("h", F.sha2(F.concat_ws(":", F.lit("42"), "company_id", "story"), 256)).orderBy("h").limit(100)


def capped_pick(spark, sf_dir):
    """At most four articles a company, twenty in all, most negative first."""
    order = [F.desc("negative"), F.col("article_id")]
    own = articles(spark, sf_dir).withColumn("own", F.row_number().over(Window.partitionBy("company_id").orderBy(*order))).where("own <= 4")
    return own.orderBy(*order).limit(20).select("company_id", "article_id", F.col("own").cast("long").alias("own"))


def union_top_fill(spark, sf_dir):
    """Half by negativity, half spread over sources, without repeats, per company."""
    by = lambda cols, *o: Window.partitionBy(*cols).orderBy(*o)
    rows = articles(spark, sf_dir).withColumn("a", F.row_number().over(by(["company_id"], F.desc("negative"), "article_id"))).withColumn("s", F.row_number().over(by(["company_id", "source"], F.desc("seen_at"), "article_id")))
    return rows.where("a <= 4 or s <= 1").select("company_id", "article_id", (F.col("a") <= 4).alias("by_score"))


def set_difference(spark, sf_dir):
    """Customers without an order, and orders without a line: what a sync would drop."""
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id", "left_anti")
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")).join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), "id", "left_anti")
    return c.select("kind", "id").union(o.select("kind", "id"))


def star_without_fan_out(spark, sf_dir):
    """Orders and lines of each segment, each side aggregated before the join."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.sum("lines").alias("lines"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


QUERIES = {f.__name__: f for f in (anti_unlabelled, semi_exists, not_in_non_risk, union_of_ids, labelled_pairs, range_join_windows, asof_previous, topk_evidence, stratified_cells, hash_sample, capped_pick, union_top_fill, set_difference, star_without_fan_out)}

ORACLE_SQL = {
    "anti_unlabelled": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "semi_exists": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')",
    "not_in_non_risk": f"WITH {ARTICLES_SQL} SELECT DISTINCT company_id, story FROM articles WHERE (company_id, story) NOT IN (SELECT (company_id, story) FROM articles WHERE negative >= 0.85 AND story IS NOT NULL)",
    "union_of_ids": f"WITH {FILTERS_SQL} SELECT raw_id FROM filters WHERE newest = 1 AND decision = 'A' UNION SELECT raw_id FROM filters WHERE decision = 'R' AND status = 'F'",
    "labelled_pairs": f"""WITH {ARTICLES_SQL}, s AS (SELECT company_id, source, avg((label = 'negative')::INT) AS share FROM articles GROUP BY ALL)
      SELECT a.source AS source_a, b.source AS source_b, count(*) AS n, round(avg(((a.share >= 0.34) = (b.share >= 0.34))::INT), 6) AS agreement FROM s a JOIN s b ON a.company_id = b.company_id AND a.source < b.source GROUP BY ALL""",
    "range_join_windows": f"""WITH {ARTICLES_SQL}, a AS (SELECT *, CAST(floor(epoch(seen_at)) AS BIGINT) AS s FROM articles)
      SELECT e.article_id AS error_id, count(*) AS purchases FROM a e JOIN a p ON p.company_id = e.company_id AND p.s > e.s AND p.s <= e.s + 7200 WHERE e.source = 'error' AND p.source = 'purchase' GROUP BY 1""",
    "asof_previous": f"""WITH {ARTICLES_SQL} SELECT p.article_id, p.company_id, (SELECT arg_max(v.article_id, (v.seen_at, v.article_id)) FROM articles v WHERE v.source = 'view' AND v.company_id = p.company_id AND v.seen_at < p.seen_at) AS view_id
      FROM articles p WHERE p.source = 'purchase'""",
    "topk_evidence": f"WITH {ARTICLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY negative DESC, seen_at DESC, article_id) AS rank FROM articles) SELECT company_id, rank, article_id, round(negative, 6) AS negative FROM r WHERE rank <= 3",
    "stratified_cells": f"WITH {ARTICLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source, label ORDER BY md5('seed' || article_id)) AS rank FROM articles) SELECT source, label, article_id FROM r WHERE rank <= 5",
    "hash_sample": f"WITH {ARTICLES_SQL}, s AS (SELECT DISTINCT company_id, story FROM articles) SELECT company_id, story, sha256(concat_ws(':', '42', company_id, story)) AS h FROM s ORDER BY h LIMIT 100",
    "capped_pick": f"WITH {ARTICLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY negative DESC, article_id) AS own FROM articles) SELECT company_id, article_id, own FROM r WHERE own <= 4 ORDER BY negative DESC, article_id LIMIT 20",
    "union_top_fill": f"""WITH {ARTICLES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY negative DESC, article_id) AS a, row_number() OVER (PARTITION BY company_id, source ORDER BY seen_at DESC, article_id) AS s FROM articles)
      SELECT company_id, article_id, a <= 4 AS by_score FROM r WHERE a <= 4 OR s <= 1""",
    "set_difference": "SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "star_without_fan_out": """SELECT c_mktsegment, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
}
