"""Structured Streaming twins: feature windows over late articles, kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def article_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Articles as files arrive in a folder; `seen_at` is the time of the event."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withColumn("seen_at", F.col("seen_at").cast("timestamp"))


def windowed(rows: DataFrame, width: str = "15 minutes", late: str | None = "60 minutes") -> DataFrame:
    """Counts and sentiment of each company and window; rows more than `late` behind
    the newest are dropped, so state stays bounded. None if rows have a watermark."""
    grouped = (rows.withWatermark("seen_at", late) if late else rows).groupBy("company_id", F.window("seen_at", width).alias("w"))
    found = grouped.agg(F.count(F.lit(1)).alias("articles"), F.avg("negative").alias("mean_negative"), F.max("negative").alias("max_negative"))
    return found.select("company_id", F.col("w.start").alias("window_start"), "articles", "mean_negative", "max_negative")


def keep_table(rows: DataFrame, path: str, checkpoint: str):
    """Run the windows until the input is used up; each batch's updated windows are
    written under its batch id, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The table that keep_table holds: of each window its newest update."""
    rows = spark.read.parquet(f"{path}/batch=*")
    columns = [c for c in rows.columns if c != "batch_id"]
    best = rows.groupBy("company_id", "window_start").agg(F.max_by(F.struct(*columns), "batch_id").alias("x"))
    return best.select("x.*")
