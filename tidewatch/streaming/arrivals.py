"""Articles collected in runs that overlap, streamed into a table of feature windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.scratch import shared_folder
from tidewatch.sources.tables import ARTICLES_SQL, articles
from tidewatch.streaming.windows import article_stream, keep_table, newest, windowed

#: Each run reads again what was created up to so many minutes before it began.
OVERLAP = 60
#: How far behind the newest an article may be seen: 70 minutes by its publication, and a margin.
LATE = "120 minutes"
#: When the queries' runs begin.
RUNS = ("2024-01-11", "2024-01-21")
ARRIVED = "article_id long, company_id long, seen_at timestamp, negative double"
KEPT = "company_id long, window_start timestamp, articles long, mean_negative double, max_negative double, batch_id int"


def collect(rows: DataFrame, folder: str, checkpoint: str, kept: str, arrived: DataFrame) -> None:
    """One run: put what arrived into the folder and stream it into the table `kept`. An
    article that an earlier run read counts once: its id is remembered for as long as
    its time is not too late. A run that breaks off is continued by the next."""
    arrived.write.mode("append").parquet(folder)
    once = article_stream(rows.sparkSession, folder, rows.schema).withWatermark("seen_at", LATE).dropDuplicates(["article_id", "seen_at"])
    keep_table(windowed(once, late=None), kept, checkpoint).awaitTermination()


def late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of fifteen minutes from three runs, each reading again the last hour of the one
    before: articles, mean and largest negative probability. Late articles correct their
    window, repeated ones do not. Articles without id or time have no part."""
    where = shared_folder(spark)
    folder, checkpoint, kept = f"{where}/arrived", f"{where}/state", f"{where}/windows"
    rows = articles(spark, sf_dir).where("article_id IS NOT NULL AND seen_at IS NOT NULL").select("article_id", "company_id", F.col("seen_at").cast("timestamp").alias("seen_at"), "negative", "created_at")
    spark.createDataFrame([], KEPT).write.parquet(f"{kept}/batch=-1")  # so that there is a table if nothing arrives
    borders = [None, *RUNS, None]
    for begin, end in zip(borders, borders[1:]):
        now = rows
        if begin:
            now = now.where(F.col("created_at") >= F.lit(begin).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(OVERLAP)))
        if end:
            now = now.where(F.col("created_at") < F.lit(end).cast("timestamp_ntz"))
        collect(rows.drop("created_at"), folder, checkpoint, kept, now.drop("created_at"))
    found = newest(spark, kept)
    rounded = [F.round(c, 6).alias(c) for c in ("mean_negative", "max_negative")]
    return found.select("company_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "articles", *rounded)


QUERIES = {f.__name__: f for f in (late_windows,)}

ORACLE_SQL = {
    "late_windows": f"""WITH {ARTICLES_SQL} SELECT company_id, time_bucket(INTERVAL '15 minutes', seen_at, TIMESTAMP '1970-01-01') AS window_start, count(*) AS articles, round(avg(negative), 6) AS mean_negative, round(max(negative), 6) AS max_negative
      FROM articles WHERE seen_at IS NOT NULL GROUP BY ALL""",
}
