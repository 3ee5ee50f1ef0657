"""Scalar rules, as Column expressions where one expression will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def median_of(values: Column, q: float = 0.5) -> Column:
    """Linear-interpolated quantile of an array; null if it is empty."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(q)
    low, high = F.element_at(ordered, (F.floor(at) + 1).cast("int")), F.element_at(ordered, (F.ceil(at) + 1).cast("int"))
    return F.when(F.size(values) > 0, low + (high - low) * (at - F.floor(at)))


def with_robust_z(df: DataFrame, value: str, history: str, name: str = "z") -> DataFrame:
    """df with the distance of `value` from the median of the array `history` in robust
    deviations, clipped to +-20: 0 with fewer than 8 values; a spread of 0 falls back on
    the quartiles, then on a sign. Step by step, so that no step repeats another."""
    h, v = F.col(history), F.col(value)
    steps = df.withColumn("__middle", median_of(h))
    steps = steps.withColumn("__mad", median_of(F.transform(h, lambda x: F.abs(x - F.col("__middle")))) * 1.4826)
    steps = steps.withColumn("__iqr", (median_of(h, 0.75) - median_of(h, 0.25)) / 1.349)
    steps = steps.withColumn("__spread", F.when(F.col("__mad") < 1e-9, F.col("__iqr")).otherwise(F.col("__mad")))
    off = v - F.col("__middle")
    far = F.when(F.abs(off) < 1e-9, 0.0).otherwise(F.signum(off) * 10)
    z = F.when(F.size(h) < 8, 0.0).when(F.col("__spread") < 1e-9, far).otherwise(F.greatest(F.least(off / F.col("__spread"), F.lit(20.0)), F.lit(-20.0)))
    return steps.withColumn(name, z).drop("__middle", "__mad", "__iqr", "__spread")

