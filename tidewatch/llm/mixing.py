"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import with_positions

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Expected copies are whole multiples of 2**-BITS: sums of them are exact.
BITS = 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """For rows (source, source_size), add `target`: the sources, in code-point
    order with null last, have the weights in turn and share the sum of all sizes;
    no target is above `repeats` times its source's size, and what is above goes to
    the others by weight until none is above.

    With the sources ordered by limit over weight, those at their limit come
    first; source i is among them if what the ones before leave, shared by weight,
    would exceed its limit. So one running sum finds the level at which all end.
    The table has a row for each source, so ordering it in one task is cheap."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")).cast("long")
    rows = sizes.withColumns({"weight": weight, "limit": F.col("source_size") * repeats})
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "total": F.sum("source_size").over(everything),
        "filled": F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    rows = rows.withColumn("full", (F.col("total") - F.col("filled")) * F.col("weight") > F.col("limit") * F.col("left_weight"))
    rows = rows.withColumns({
        "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0)),
        "sharing": F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything), F.lit(1)),
    })
    shared = F.col("rest").cast("double") * F.col("weight") / F.col("sharing")
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(shared).alias("target"))


def offset(source: Column, seed: str) -> Column:
    """A source's random offset in [0, 2**BITS), fixed by the seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit("="), source), F.lit("-")))), 1, BITS // 4), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS, seed: str = "mix", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, source, size, source_size, target, copies (how often the
    mix takes the document) and taken (copies times size), a row for each document.

    A document's expected copies are its source's target over its source's size.
    Within a source the documents stand in order of size and then of `keep`; where
    the running sum of expected copies, shifted by the source's offset, crosses a
    whole number, a copy is taken. As neighbours are of like size, a source's words
    come within about one document of its target; as no expectation is above
    `repeats`, no document is taken more often. The result depends only on the rows
    and the seed.

    Sizes are words between ASCII white space (null: 0 words). Null sources are a
    source of their own. Rows that repeat are documents of their own. A source
    without words has target 0 and is not taken. An empty table gives an empty
    one."""
    sized = docs.select(*keep, F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    rows = with_positions(sized, ["source", "size", *keep], "mix", group="source")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, weights, repeats).withColumnRenamed("source", "__source")
    expected = F.least(F.round(F.col("target") / F.col("source_size") * (1 << BITS)).cast("long"), F.lit(repeats << BITS))
    aims = aims.withColumns({"expected": F.when(F.col("source_size") > 0, expected).otherwise(0), "offset": offset(F.col("__source"), seed)})
    upto = F.col("position") * F.col("expected") + F.col("offset")
    copies = F.shiftright(upto + F.col("expected"), BITS) - F.shiftright(upto, BITS)
    joined = rows.join(aims, F.col("source").eqNullSafe(F.col("__source")))
    return joined.select(*keep, "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def copies_of(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: each row of docs, all columns, as many times as `mix` takes it.

    Copies are decided on light rows (id, source, hash of the text) and joined back by
    these; rows that are equal in them share their copies, in order of a hash of all
    their columns. Null texts and such without words are not taken; null sources are one
    source. An empty table gives an empty one. No column may be named like those used
    here, which begin with two underscores."""
    marked = docs.withColumn("__hash", F.xxhash64(F.col(text_col)))
    taken = mix(marked, text_col=text_col, source_col=source_col, keep=(id_col, "__hash"))
    taken = taken.groupBy(F.col(id_col).alias("__id"), F.col("source").alias("__source"), "__hash").agg(F.sum("copies").alias("__sum"), F.count(F.lit(1)).alias("__rows"))
    taken = taken.where("__sum > 0").withColumnRenamed("__hash", "__of")
    met = (F.col(id_col).eqNullSafe(F.col("__id"))) & (F.col(source_col).eqNullSafe(F.col("__source"))) & (F.col("__hash") == F.col("__of"))
    joined = marked.join(taken, met)
    at = F.row_number().over(Window.partitionBy(id_col, source_col, "__hash").orderBy(F.xxhash64(*docs.columns)))
    joined = joined.withColumn("__at", F.when(F.col("__rows") > 1, at - 1).otherwise(0))
    own = F.floor(F.col("__sum") / F.col("__rows")) + (F.col("__at") < F.col("__sum") % F.col("__rows")).cast("int")
    return joined.withColumn("__own", own.cast("int")).where("__own > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__own")))).select(*docs.columns)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) - 1 AS position FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS lim, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
r AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
  CAST(coalesce(sum(lim) OVER b, 0) AS BIGINT) AS filled,
  CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS left_weight
  FROM w WINDOW b AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - filled) * weight > lim * left_weight AS is_full FROM r),
t AS (SELECT *, CAST(total - coalesce(sum(lim) FILTER (WHERE is_full) OVER (), 0) AS BIGINT) AS rest,
  CAST(coalesce(sum(weight) FILTER (WHERE NOT is_full) OVER (), 1) AS BIGINT) AS sharing FROM f),
a AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(lim AS DOUBLE) ELSE CAST(rest AS DOUBLE) * weight / sharing END AS target,
  CAST('0x' || substr(md5('mix' || coalesce('=' || source, '-')), 1, 5) AS BIGINT) AS off FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(round(target / source_size * 1048576) AS BIGINT), 3 * 1048576) ELSE 0 END AS expected FROM a)
SELECT doc_id, size, source_size, target,
  (((position + 1) * expected + off) // 1048576 - (position * expected + off) // 1048576) * size AS taken
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""
