"""Files as sources and sinks: CSV with a mark, JSON lines with a torn tail, one nested JSON
document, reports, backups, text in chunks, a vector store, a table changed in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a chunk and of what it repeats of the one before; the least of a last one.
CHUNK, OVERLAP, LEAST = 800, 100, 120


def labels_csv(spark: SparkSession, path: str, column: str, valid: list[str]) -> DataFrame:
    """Rows of a CSV with a header whose label is valid. A byte order mark at the start is
    no part of the first name; blanks around labels do not count."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return rows.withColumn(column, F.upper(F.trim(column))).where(F.col(column).isin(valid))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines. A last line that was torn off is left out; a broken line
    anywhere else is an error, as it is lost data. Null and empty files have no rows."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    last = lines.groupBy("file").agg(F.max("at").alias("last"))
    marked = parsed.join(last, "file").withColumn("bad", F.col("row._broken").isNotNull())
    lost = F.raise_error(F.concat(F.lit("broken line in "), F.col("file"))).cast("boolean")
    kept = F.when(~F.col("bad"), F.lit(True)).when(F.col("at") < F.col("last"), lost).otherwise(F.lit(False))
    return marked.where(kept).select("row.*").drop("_broken")


def nested_map(spark: SparkSession, path: str) -> DataFrame:
    """(type, item columns) of one JSON document {types: {name: {items: [...]}}}."""
    doc = spark.read.text(path, wholetext=True)
    shape = "types map<string, struct<items: array<struct<id: string, verified: boolean, hours: int>>>>"
    each = doc.select(F.explode(F.map_entries(F.from_json("value", shape)["types"])).alias("e"))
    return each.select(F.col("e.key").alias("type"), F.explode_outer("e.value.items").alias("i")).select("type", "i.*")


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A report as CSV with a header, or as JSON lines, in as many files as df has parts;
    what was there is replaced when all is written."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if form == "csv" else writer.json(path)


def back_up(df: DataFrame, path: str) -> None:
    """Whole rows as JSON lines, to be kept before they are changed."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("error").text(path)


def chunks(pages: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Pages (doc_id, page, text) in chunks of `size` characters, each repeating `overlap` of
    the one before; a last one below `least` belongs to the one before. Empty and null
    texts have none."""
    step = size - overlap
    length = F.char_length("text")
    n = F.greatest(F.lit(1), F.floor((length - overlap - least) / step) + 1)
    starts = F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    rows = pages.where(length > 0).select("doc_id", "page", "text", (n.cast("int") - 1).alias("last"), starts.alias("chunk"))
    till = F.when(F.col("chunk") == F.col("last"), F.char_length("text")).otherwise(F.lit(size)).cast("int")
    return rows.select("doc_id", "page", "chunk", F.substr("text", F.col("chunk") * step + 1, till).alias("text"))


def save_vectors(df: DataFrame, path: str) -> None:
    """Vectors (id, vector, and more) as a store in Parquet."""
    df.write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The store at path, or None if there is none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    return spark.read.parquet(path) if exists else None


def merged(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """stored after changes: rows of equal keys take the changed columns, new keys come in,
    the others stay; columns that changes lacks stay as they are, null for new rows."""
    sides = stored.select(F.struct("*").alias("s")), changes.select(F.struct("*").alias("c"))
    on = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    both = sides[0].join(sides[1], on, "full")
    pick = lambda c: (F.when(F.col("c").isNotNull(), F.col(f"c.{c}")).otherwise(F.col(f"s.{c}")) if c in changes.columns else F.col(f"s.{c}")).alias(c)
    return both.select(*[pick(c) for c in stored.columns])
