"""Positions in an order without sorting all rows, or all rows of a hot key, in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.sources.scratch import written


def with_positions(rows: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """rows with their position from 0, in `order` within each value of `group` (of all, if
    there is none). The order must tell rows apart. Null keys are a value like others.

    Ranges of the order are dealt to tasks and numbered there; the counts of the ranges
    before, a row for each range and key in it, give the offsets. The ranged rows are a
    table in the shared folder, so ranges do not change between its two uses."""
    keys = [F.col(c).asc_nulls_first() for c in group]
    ranged = written(rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    own = Window.partitionBy("__range", *group)
    counts = ranged.groupBy("__range", *group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    met = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ["__range", *group]])
    numbered = ranged.withColumn("__local", F.row_number().over(own.orderBy(*order)) - 1).alias("r").join(offsets.alias("o"), met)
    return numbered.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("o.__offset") + F.col("r.__local")).alias(name))
