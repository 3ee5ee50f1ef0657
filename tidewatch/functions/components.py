"""Connected components by large and small stars.

Every round hangs each node's larger neighbours on its smallest neighbour, then its
smaller ones on the smallest of all. Nodes stay connected as they were, and trees become
stars after a number of rounds that grows with the logarithm of the nodes, not with the
diameter. Each round is a minimum by key and a join, written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.scratch import discard, written


def _large(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame):
    """Tells one set of links from another."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of links (a, b) that have a neighbour: root is the least node
    of the component. Links may repeat, point either way or to themselves; ends that are null
    link nothing. No links give an empty table."""
    start = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(start)
    mark = _mark(now)
    while True:
        then = written(_small(_large(now)))
        discard(now)
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def linked_by(rows: DataFrame, node: str, token: str) -> DataFrame:
    """Links (a, b) that bring together all nodes of a token, through its least node: as many as
    rows, however many nodes share a token. Null tokens link nothing."""
    rows = rows.select(F.col(node).alias("a"), F.col(token).alias("token")).where("a IS NOT NULL AND token IS NOT NULL")
    hubs = rows.groupBy("token").agg(F.min("a").alias("b"))
    return rows.join(hubs, "token").where("a <> b").select("a", "b").distinct()
