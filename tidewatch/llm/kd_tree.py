"""Exact top-k by inner product with a KD-tree in each shard.

Vectors are dealt into shards of bounded size by hash. A shard's task gets its vectors
first, builds one tree of median splits whose nodes keep tight bounding boxes, and
then answers the queries that come after, a batch at a time: nodes are visited best
bound first, until the best bound left is below the query's k-th score. Queries
search their own shard first, then a few others, then all the rest, and the best
k-th score found so far goes with them and prunes from the start. So vectors are
shuffled once a wave, and no task holds more than a shard and a batch of queries.
"""

from __future__ import annotations

import math
from heapq import heappop, heappush

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import settle
from tidewatch.llm.vectors import matrix, usable

#: Vectors of a shard, about; vectors of a leaf at most.
SHARD_ROWS = 8_192
LEAF_ROWS = 256


class Tree:
    """Median splits along the widest side of each box, over integer vectors."""

    def __init__(self, ids, vectors, leaf_rows: int = LEAF_ROWS):
        import numpy as np

        order, spans, children, lo, hi = np.arange(len(ids)), [], [], [], []

        def grow(a: int, b: int) -> int:
            own, node = vectors[order[a:b]], len(spans)
            spans.append((a, b))
            children.append(())
            lo.append(own.min(0))
            hi.append(own.max(0))
            wide = hi[-1] - lo[-1]
            if b - a > leaf_rows and wide.max() > 0:
                mid = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, wide.argmax()], mid - a)]
                children[node] = (grow(a, mid), grow(mid, b))
            return node

        grow(0, len(ids))
        self.spans, self.children, self.ids, self.vectors = spans, children, ids[order], vectors[order]
        self.lo, self.hi = np.array(lo), np.array(hi)

    def bounds(self, queries):
        """No vector in a node's box has a larger inner product with the query."""
        import numpy as np

        most = np.maximum(queries, 0) @ self.hi.T.astype(float) + np.minimum(queries, 0) @ self.lo.T.astype(float)
        return most + np.abs(most) * 1e-9  # exact sums never lie above, rounded ones neither

    def best(self, query, bound, own_id: int, k: int, least: float):
        """The k best (scores, ids), best first, of those not below `least`."""
        import numpy as np

        scores, ids = np.empty(0, self.vectors.dtype), np.empty(0, np.int64)
        heap = [(-bound[0], 0)]
        while heap:
            most, node = heappop(heap)
            if -most < least:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bound[child] >= least:
                        heappush(heap, (-bound[child], child))
                continue
            a, b = self.spans[node]
            s = self.vectors[a:b] @ query
            of = np.flatnonzero((s >= least) & (self.ids[a:b] != own_id))
            scores, ids = np.concatenate([scores, s[of]]), np.concatenate([ids, self.ids[a:b][of]])
            if len(scores) > k:
                top = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[top], ids[top]
            if len(scores) >= k:
                least = max(least, scores.min())
        top = np.lexsort((ids, -scores))
        return scores[top], ids[top]


def _search(k: int):
    """Rows (dim, shard, asks, vec_id, query_hash, least, vector), each shard's vectors
    before its queries, to (query_id, query_hash, vec_id, score)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["query_id", "query_hash", "vec_id", "score"]
        shard, waiting, tree = None, [], None

        def grown():
            ids, x = np.concatenate([i for i, _ in waiting]), np.concatenate([v for _, v in waiting])
            _, once = np.unique(np.column_stack([ids, x]), axis=0, return_index=True)
            return Tree(ids[once], x[once])

        def answers(queries):
            q = matrix(queries.column("vector"))
            x = tree.vectors
            exact = max(np.abs(x).max().astype(float), 1) * max(np.abs(q).max().astype(float), 1) * x.shape[1] < 2**53
            if exact and x.dtype != float:
                tree.vectors = x.astype(float)
            elif not exact:
                tree.vectors = x.astype(np.int64)
            q = q.astype(tree.vectors.dtype)
            bounds = tree.bounds(q.astype(float))
            least = queries.column("least").to_numpy(zero_copy_only=False).astype(float)
            out: list = [[], [], [], []]
            for i, (own, h) in enumerate(zip(queries.column("vec_id").to_pylist(), queries.column("query_hash").to_pylist())):
                scores, found = tree.best(q[i], bounds[i], own, k, least[i] if least[i] == least[i] else -math.inf)
                for column, value in zip(out, (np.full(len(found), own), np.full(len(found), h), found, scores.astype(np.int64))):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=names)

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "shard", "asks")])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if a == b:
                    continue
                rows, own = batch.slice(a, b - a), (keys[a][0], keys[a][1])
                if own != shard:
                    shard, waiting, tree = own, [], None
                if not keys[a][2]:
                    waiting.append((rows.column("vec_id").to_numpy(), matrix(rows.column("vector"))))
                elif waiting or tree:
                    tree, waiting = tree or grown(), []
                    yield answers(rows)

    return run


def top_k(df: DataFrame, k: int, is_query, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each row for which `is_query` (a function of the id column) holds, the k
    highest integer inner products with other rows: query_id, rank, vec_id, score.

    Components become floor(scale * x), as 64-bit integers; scores that exceed 64
    bits wrap. Ties go to the smaller vec_id; fewer rows than k give all. Vectors
    that are null or empty, or hold a null or non-finite component, and rows without
    an id take no part. Rows with the query's id are not its candidates; rows equal
    in id and vector count once; vectors of another length never meet; queries of one
    id and other vectors are answered each. Other columns are ignored. An empty table
    gives an empty result."""
    rows = usable(df, id_col, vector_col)
    rows = rows.select("vec_id", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"), F.size("vector").alias("dim"))
    rows = rows.withColumn("query_hash", F.xxhash64("vec_id", "vector"))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    rows = rows.withColumn("shard", F.pmod("query_hash", F.lit(shards)).cast("int"))
    queries = rows.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "query_hash"])
    columns = ["dim", "shard", "asks", "vec_id", "query_hash", "least", "vector"]
    none = F.lit(None).cast("long")
    stored = rows.select("dim", "shard", F.lit(False).alias("asks"), "vec_id", "query_hash", none.alias("least"), "vector")
    best = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    few = math.isqrt(shards)
    waves = [(0, 1), (1, 1 + few), (1 + few, shards)]
    found = None
    for a, b in ((a, min(b, shards)) for a, b in waves if a < shards):
        asks = queries.withColumn("least", none)
        if found is not None:
            kth = found.groupBy("query_id", "query_hash").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
            kth = kth.where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("query_hash").alias("hash"), "least")
            asks = queries.join(kth, (F.col("vec_id") == F.col("id")) & (F.col("query_hash") == F.col("hash")), "left")
        to = F.explode(F.transform(F.sequence(F.lit(a), F.lit(b - 1)), lambda s: ((F.col("shard") + s) % shards).cast("int")))
        asks = asks.select("dim", to.alias("shard"), F.lit(True).alias("asks"), "vec_id", "query_hash", "least", "vector")
        met = stored.unionByName(asks).select(columns).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "asks")
        more = met.mapInArrow(_search(k), "query_id long, query_hash long, vec_id long, score long")
        more = more if found is None else more.unionByName(found)
        found = settle(more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "kd-found")
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, 20, lambda i: i % 20 == 0)


OP5_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.w AS asked, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
