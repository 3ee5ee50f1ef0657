"""Connected components of a table of links, by smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import release, settle


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the smallest node of the
    node's component. Every step is written to the shared folder, so lineage stays
    short and lost executors cost one step; the work of a step is in proportion to the
    links, whatever the size of a component. No links give an empty table."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = settle(both.where("a <> b").distinct(), "cc-links")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "cc-labels")
    while True:
        met = labels.select(F.col("node").alias("b"), "label")
        near = both.join(met, "b").select(F.col("a").alias("node"), "label")
        least = settle(near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label")), "cc-least")
        of_label = least.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
        jumped = least.join(of_label, F.col("label") == F.col("__node")).select("node", F.least("label", "__label").alias("label"))
        jumped = settle(jumped, "cc-labels")
        old = labels.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
        changed = not jumped.join(old, (F.col("node") == F.col("__node")) & (F.col("label") != F.col("__label"))).isEmpty()
        release(least, labels)
        labels = jumped
        if not changed:
            release(both)
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels as `components` gives them, after more links: only the labels that the
    new links bring together are looked at again. The old table is released."""
    if labels is None:
        return components(links)
    of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    ends = links.join(of_a, "a", "left").join(of_b, "b", "left")
    ends = settle(ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).distinct(), "cc-ends")
    joined = components(ends)
    moves = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    known = labels.join(moves, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    out = settle(known.unionByName(joined.join(labels, "node", "left_anti")), "cc-labels")
    release(ends, joined, labels)
    return out
