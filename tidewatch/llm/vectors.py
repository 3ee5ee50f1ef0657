"""Shared by the two vector searches: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that is not null or empty and has finite components only."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, good), F.lit(False))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id long, vector array<double>) that take part in a search: those
    with an id and a finite vector."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & finite(F.col("vector")))


def matrix(column):
    """A numpy matrix of an Arrow list column whose lists are all of one length."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)
