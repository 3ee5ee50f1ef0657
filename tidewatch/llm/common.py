"""Shared by the training-data operators: scratch tables in the cluster's shared
folder, Arrow batch sizes, and ordered prefix positions without a one-task sort."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bounds of one Arrow batch of texts; a batch ends where the first of them is met.
TEXT_ROWS_PER_BATCH, TEXT_BYTES_PER_BATCH = 256, 16 << 20

_local_scratch: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset
    and the session runs on this machine alone (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_scratch:
        _local_scratch.append("file://" + tempfile.mkdtemp(prefix="spark-tidewatch-"))
        spark.sparkContext.setCheckpointDir(_local_scratch[0])
    return _local_scratch[0]


def scratch_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{scratch_root(spark)}/tidewatch/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once the results that
    read them are written. Does nothing if there are none."""
    _delete(spark, scratch_folder(spark))


def settle(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: later steps start from
    files that outlive any executor, and joins on it start from an exchange that
    adaptive execution can split when a key is hot. zstd suits tables that are large
    and stay for long."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled.settled_at = path
    return settled


def settle_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """`settle`, as a table in buckets of `key`, one for each shuffle partition: joins
    on the key do not shuffle it again. For keys that are few rows each only, as a
    bucket is one task's. `settled_at` read as plain Parquet has no buckets."""
    spark, table = df.sparkSession, f"tidewatch_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).format("parquet").option("path", path).saveAsTable(table)
    settled = spark.table(table)
    settled.settled_at, settled.settled_as = path, table
    return settled


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more. Frames made from a settled
    one keep no file of their own; they must be settled first."""
    for df in tables:
        if "settled_as" in vars(df):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.settled_as}")
        _delete(df.sparkSession, df.settled_at)


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and bytes, as texts may be long.
    The session's own bounds stay where they are lower. A plan reads them when it
    runs, which is after the operator has returned, so they cannot be put back."""
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS_PER_BATCH), ("maxBytesPerBatch", TEXT_BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def kept(df: DataFrame, keep: list[str] | None, used: list[str], results: list[str]) -> list[str]:
    """Columns that pass through: `keep`, or else all but those used up and those
    that share a name with a result."""
    if keep is not None:
        return keep
    taken = {c.lower() for c in [*used, *results]}
    return [c for c in df.columns if c.lower() not in taken]


def schema_with(df: DataFrame, ddl: str) -> StructType:
    """The schema of df and more fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col(f"`{name.replace('`', '``')}`")


def in_batches(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """`df.mapInArrow(run, schema)` for columns of any names, dots and repeats included:
    they travel by position."""
    names = [f"c{i}" for i in range(len(schema.fields))]

    def renamed(batches):
        import pyarrow as pa

        for out in run(batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=names)

    travelling = StructType([StructField(n, f.dataType, True) for n, f in zip(names, schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(renamed, travelling).toDF(*schema.names)


def with_positions(df: DataFrame, order: list[str], name: str, group: str | None = None, partitions: int | None = None) -> DataFrame:
    """Number the rows from 0 in the given order, within each value of `group`
    (the first ordering column) if given, as column `position`.

    A range partitioning and a sort inside partitions give local positions; the
    row counts of earlier partitions, one small row for each partition and group,
    give the offsets. No task ever sees more than its own range of rows. The
    result is a settled table, so positions do not change between reads.
    """
    df = settle(df, f"{name}-rows")  # range bounds are sampled from it, so it is read twice
    cols = [F.col(c).asc_nulls_last() for c in order]
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    ranged = ranged.sortWithinPartitions(*cols)
    schema = schema_with(df, "__part int, __local long")
    at = df.columns.index(group) if group else None

    def number(batches):
        import numpy as np
        import pyarrow as pa

        part, seen, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            local = np.arange(seen, seen + n, dtype=np.int64)
            if at is not None:
                keys = np.array(batch.column(at).to_pylist(), dtype=object)
                new = np.ones(n, bool)
                new[1:] = keys[1:] != keys[:-1]
                new[0] = seen == 0 or keys[0] != last
                starts = np.flatnonzero(new)
                base = np.zeros(n, np.int64)
                base[starts] = np.arange(n)[starts]
                base = np.maximum.accumulate(base)
                local = np.arange(n) - base
                head = n if len(starts) == 0 else starts[0]
                local[:head] += seen
                seen = int(local[-1]) + 1
                last = keys[-1]
            else:
                seen += n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(local.astype(np.int64))],
                names=[*batch.schema.names, "__part", "__local"],
            )

    rows = settle(ranged.mapInArrow(number, schema), name)
    release(df)
    keys = ["__part", group] if group else ["__part"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    before = before.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return rows.join(offsets, on).select(*df.columns, (F.col("__offset") + F.col("__local")).alias("position"))
