"""The input tables, and the views of them that stand for articles, stories,
filter results and collection attempts. Each view has the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an article: its company, source, times, negative probability, label and
    story. An article is published up to 70 minutes before it is created here; the
    publication time is missing for some, and `seen_at` falls back on creation."""
    negative = F.least(F.col("value") / 100, F.lit(1.0))
    published = F.when(F.col("event_id") % 7 != 0, F.col("ts") - F.make_dt_interval(mins=(F.col("event_id") % 11 * 7).cast("int")))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("article_id"), (F.col("user_id") % 50).alias("company_id"), F.col("event_type").alias("source"),
        published.alias("published_at"), F.col("ts").alias("created_at"), F.coalesce(published, F.col("ts")).alias("seen_at"), negative.alias("negative"),
        F.when(negative >= 0.66, "negative").when(negative >= 0.33, "neutral").otherwise("positive").alias("label"),
        F.get_json_object("props", "$.k").cast("long").alias("story"),
    )


def filter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only decisions on raw articles, with a total order of versions."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("raw_id"), F.col("l_returnflag").alias("decision"), F.col("l_linestatus").alias("status"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("version"),
        F.col("l_shipdate").alias("filtered_at"), F.col("l_discount").alias("confidence"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection attempts: company, source, slot, whether it succeeded."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("attempt_id"), (F.col("o_custkey") % 10).alias("company_id"), F.col("o_orderpriority").alias("source"),
        F.col("o_orderdate").alias("slot"), (F.col("o_orderstatus") != "F").alias("succeeded"),
    )


ARTICLES_SQL = """articles AS (SELECT event_id AS article_id, user_id % 50 AS company_id, event_type AS source,
  CASE WHEN event_id % 7 <> 0 THEN ts - to_minutes(CAST(event_id % 11 * 7 AS INT)) END AS published_at, ts AS created_at, CASE WHEN event_id % 7 <> 0 THEN ts - to_minutes(CAST(event_id % 11 * 7 AS INT)) ELSE ts END AS seen_at, least(value / 100, 1.0) AS negative,
  CASE WHEN least(value / 100, 1.0) >= 0.66 THEN 'negative' WHEN least(value / 100, 1.0) >= 0.33 THEN 'neutral' ELSE 'positive' END AS label,
  CAST(json_extract(props, '$.k') AS BIGINT) AS story FROM events)"""
FILTERS_SQL = """filters AS (SELECT l_orderkey AS raw_id, l_returnflag AS decision, l_linestatus AS status, l_shipdate AS filtered_at, l_discount AS confidence,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_shipdate DESC) AS newest FROM lineitem)"""
ATTEMPTS_SQL = """attempts AS (SELECT o_orderkey AS attempt_id, o_custkey % 10 AS company_id, o_orderpriority AS source, o_orderdate AS slot, o_orderstatus <> 'F' AS succeeded FROM orders)"""
