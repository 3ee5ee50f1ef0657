"""Approximate nearest neighbours from several shifted Hilbert orderings.

Each ordering projects the vectors onto a few random directions, shifts them at
random and sorts light rows (two hashes of the vector and its Hilbert key): a range
partitioning in Spark. Neighbouring windows of the order are compared with the query
by exact cosine, and the windows of all orderings are merged.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tidewatch.llm.common import settle, with_positions
from tidewatch.llm.vectors import matrix, usable

#: Orderings; share of the distinct vectors that a window takes to either side (at
#: least WINDOW_LEAST of them); directions and bits of a key; most vectors in a block.
#: Without structure in the vectors, recall depends on the share that is compared, so
#: the window is a share: recall is then alike at every size. A query is compared with
#: 2 * CURVES * WINDOW_SHARE = 0.96 of the vectors, 0.6 of them different ones.
CURVES = 24
WINDOW_SHARE = 0.02
WINDOW_LEAST = 16
DIRECTIONS = 8
BITS = 6
BLOCK_ROWS = 2_048


def hilbert_keys(cells, bits: int):
    """Hilbert index of each row of an integer matrix with `bits` bits a column:
    Gray-code the coordinates from the highest bit down, rotating and reflecting
    each sub-cube so that neighbours stay neighbours, then interleave the bits."""
    import numpy as np

    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    keys = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            keys = (keys << 1) | ((x[i] >> level) & 1)
    return keys


def _cells(unit, curve: int, directions: int, bits: int):
    """Projections on a curve's own orthogonal directions, squeezed into (0, 1) by
    the spread that unit vectors have, shifted, as cells of a grid."""
    import numpy as np

    rng = np.random.default_rng(7_919 + curve)
    dim = unit.shape[1]
    use = min(directions, dim)
    axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :use] if dim <= 512 else rng.normal(size=(dim, use)) / math.sqrt(dim)
    at = 1 / (1 + np.exp(-1.7 * math.sqrt(dim) * (unit @ axes)))
    at = (at + rng.uniform(0, 1, use)) / 2
    return np.minimum(at * (1 << bits), (1 << bits) - 1).astype(np.int64)


def _orders(curves: int, directions: int, bits: int):
    """(v1, v2, dim, vector) to (v1, v2, curve, key), a row for each curve."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                x = matrix(rows.column(3)).astype(float)
                unit = x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)
                for curve in range(curves):
                    keys = hilbert_keys(_cells(unit, curve, directions, bits), bits)
                    tag = pa.array([f"{dim}.{curve}"] * len(rows))
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), tag, pa.array(keys)], names=["v1", "v2", "curve", "key"])

    return run


def _rerank(k: int, window: int):
    """(vectors of a block, queries whose window meets it) to each query's k best
    of the block, by exact cosine."""

    def run(vectors, queries):
        import numpy as np
        import pyarrow as pa

        out: list = [[], [], [], []]
        if vectors.num_rows and queries.num_rows:
            x, q = matrix(vectors["vector"]).astype(float), matrix(queries["vector"]).astype(float)
            nx, nq = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
            near = np.abs(vectors["position"].to_numpy()[None, :] - queries["position"].to_numpy()[:, None]) <= window
            rough = np.where(near, (q / nq[:, None]) @ (x / nx[:, None]).T, -9.0)
            ids, some = vectors["ids"].to_pylist(), min(4 * k, len(x))
            pick = np.argpartition(-rough, some - 1, axis=1)[:, :some]
            v1, v2 = queries["v1"].to_pylist(), queries["v2"].to_pylist()
            for i in range(len(q)):
                # rounding may swap equals at the edge of what is picked
                edge = rough[i, pick[i]].min() if some < len(x) else -9.0
                of = np.flatnonzero(rough[i] >= edge - 1e-12) if edge > -9.0 else np.flatnonzero(near[i])
                score = (q[i] * x[of]).sum(1) / (nq[i] * nx[of])
                found = sorted(((-s, c) for s, j in zip(score.tolist(), of) for c in ids[j]))[:k]
                out[0] += [v1[i]] * len(found)
                out[1] += [v2[i]] * len(found)
                out[2] += [c for _, c in found]
                out[3] += [-s for s, _ in found]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=["v1", "v2", "vec_id", "score"])

    return run


def nearest(df: DataFrame, k: int, is_query, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, share: float = WINDOW_SHARE, directions: int = DIRECTIONS, bits: int = BITS) -> DataFrame:
    """For each row for which `is_query` (a function of the id column) holds, the k
    rows of largest cosine among those found: query_id, rank, vec_id, score.

    Scores are the cosine in double precision on the original vectors; ties go to
    the smaller vec_id; fewer candidates than k give all that are found. Vectors that
    are null, empty or zero, or hold a null or non-finite component, and rows without
    an id take no part. Rows with the query's id are not its candidates; rows equal in
    id and vector count once. Equal vectors stand in the orderings once, with their
    k + 1 smallest ids, which no answer can go beyond; a query set may hold any number
    of them. Other columns are ignored. An empty table gives an empty result."""
    rows = usable(df, id_col, vector_col).where(F.exists("vector", lambda x: x != 0))
    if df.schema[vector_col].dataType == ArrayType(FloatType(), df.schema[vector_col].dataType.containsNull):
        rows = rows.withColumn("vector", F.col("vector").cast("array<float>"))  # nothing is lost, and half as much travels
    rows = rows.withColumns({"v1": F.xxhash64("vector"), "v2": F.xxhash64(F.lit("second"), "vector"), "__q": is_query(F.col("vec_id"))})
    smallest = Window.partitionBy("v1", "v2").orderBy("vec_id")
    firsts = rows.dropDuplicates(["v1", "v2", "vec_id"]).withColumn("__at", F.row_number().over(smallest)).where(F.col("__at") <= k + 1)
    distinct = firsts.groupBy("v1", "v2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    asked = rows.where("__q").select("v1", "v2").distinct().withColumn("asked", F.lit(True))
    distinct = distinct.join(asked, ["v1", "v2"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    distinct = settle(distinct, "ann-distinct")
    window = max(WINDOW_LEAST, math.ceil(distinct.count() * share))
    block = min(max(window // 2, WINDOW_LEAST), BLOCK_ROWS)
    keys = distinct.select("v1", "v2", F.size("vector").alias("dim"), "vector").mapInArrow(_orders(curves, directions, bits), "v1 long, v2 long, curve string, key long")
    placed = with_positions(keys, ["curve", "key", "v1", "v2"], "ann-orders", group="curve").select("curve", "position", "v1", "v2")
    at = F.col("position")
    blocks = placed.join(distinct, ["v1", "v2"]).select("curve", F.floor(at / block).alias("block"), "position", "ids", "vector")
    meets = F.explode(F.sequence(F.floor(F.greatest(at - window, F.lit(0)) / block), F.floor((at + window) / block)))
    asking = distinct.where("asked").select(F.col("v1").alias("w1"), F.col("v2").alias("w2"), "vector")
    queries = placed.join(asking, (F.col("v1") == F.col("w1")) & (F.col("v2") == F.col("w2"))).select("curve", meets.alias("block"), "position", "v1", "v2", "vector")
    queries = queries.toDF(*queries.columns)  # columns of its own, as both sides come from `placed`
    found = blocks.groupBy("curve", "block").cogroup(queries.groupBy("curve", "block")).applyInArrow(_rerank(k + 1, window), "v1 long, v2 long, vec_id long, score double")
    best = Window.partitionBy("v1", "v2").orderBy(F.desc("score"), "vec_id")
    merged = found.groupBy("v1", "v2", "vec_id").agg(F.max("score").alias("score"))
    merged = settle(merged.withColumn("__at", F.row_number().over(best)).where(F.col("__at") <= k + 1), "ann-found")
    per_query = rows.where("__q").select(F.col("vec_id").alias("query_id"), "v1", "v2").distinct()
    lists = merged.groupBy("v1", "v2").agg(F.sort_array(F.collect_list(F.struct("__at", "vec_id", "score"))).alias("found"))
    own = per_query.join(lists, ["v1", "v2"])
    kept = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(kept).alias("rank", "f")).select("query_id", (F.col("rank") + 1).alias("rank"), "f.vec_id", "f.score")


def op6_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, 5, lambda i: i % 50 == 0)
