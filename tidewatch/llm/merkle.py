"""Merkle manifest of a dataset: a tree of digests for each group of rows, a tree of the
groups' roots above, and for each row the siblings that prove it belongs to the root.

A level is one window over (group, parent index): the ordered list of a run's digests
is both the parent's preimage and, without the own digest, the siblings. One row of each
run stands for the parent on the next level, so levels shrink by the fan-out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import quoted, settle, with_positions

FAN_OUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    """The digest of a row: of each value `-` if null, else its bytes' number, `:` and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return digest(F.concat(*parts))


@dataclass
class Manifest:
    """Levels from the leaves up: `rows` within the groups, (grp, at, node, steps) and more
    columns on the first; `groups` above them. `root` is None for an empty dataset."""

    rows: list[DataFrame]
    groups: list[DataFrame]
    root: str | None


def climb(nodes: DataFrame, name: str, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """The levels over nodes (grp, at, node): settled tables with `up`, the parent's
    index, and `steps`, an array of the node's step to its parent: the digests before
    and behind it in its run, joined. A group's only node has no step and goes up as it
    is, so all groups have as many levels, and the last holds each group's root."""
    most = nodes.agg(F.max("at")).first()[0]
    levels, count = [], 0 if most is None else most + 1
    run = Window.partitionBy("grp", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while True:
        place = (F.col("at") % fan_out).cast("int")
        seen = nodes.withColumn("up", F.expr(f"at div {fan_out}")).withColumn("run", F.collect_list("node").over(run))
        alone = (F.col("at") == 0) & (F.size("run") == 1)
        step = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("before"), F.array_join(F.slice("run", place + 2, F.lit(fan_out)), "").alias("behind"))
        seen = seen.withColumn("steps", F.when(~alone, F.array(step)).otherwise(F.array().cast("array<struct<before:string,behind:string>>")))
        above = F.when(alone, F.col("node")).otherwise(digest(F.array_join("run", "")))
        level = settle(seen.withColumn("above", F.when(place == 0, above)).drop("run"), name)
        levels.append(level)
        if count <= 1:
            return levels
        nodes = level.where("above IS NOT NULL").select("grp", F.col("up").alias("at"), F.col("above").alias("node"))  # one row of each run
        count = -(-count // fan_out)


def manifest(docs: DataFrame, group_col: str = "source", id_col: str = "doc_id", columns: tuple[str, ...] = COLUMNS, also: dict[str, Column] | None = None, fan_out: int = FAN_OUT) -> Manifest:
    """The trees over docs: leaves are the digests of `columns`, in each group in the order
    of `id_col` (null last), then of the digest; groups stand by code point, null first.
    `also` names more columns to keep beside the leaves.

    Every row is a leaf, rows that repeat too; a null group is a group of its own. Nulls,
    empty and long texts are values like others. An empty table has no root."""
    grp = F.coalesce(F.concat(F.lit("="), quoted(group_col).cast("string")), F.lit("-"))  # null stands before all others
    rows = docs.select(grp.alias("grp"), quoted(id_col).alias("id"), leaf([quoted(c) for c in columns]).alias("node"), *[v.alias(k) for k, v in (also or {}).items()])
    placed = with_positions(rows, ["grp", "id", "node"], "merkle-leaves", group="grp").withColumnRenamed("position", "at")
    levels = climb(placed, "merkle-rows", fan_out)
    tops = with_positions(levels[-1].select(F.col("grp").alias("of"), "node"), ["of"], "merkle-groups")
    above = climb(tops.select(F.lit("").alias("grp"), F.col("position").alias("at"), "node", "of"), "merkle-roots", fan_out)
    root = above[-1].select("node").first()
    return Manifest(levels, above, root[0] if root else None)


def _down(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The first level's rows with `path`, the steps from there to the root. top: (grp, at, path)
    and more columns, for the parents of the last level's rows."""
    more = [c for c in top.columns if c not in ("grp", "at", "path")]
    for level in reversed(levels):
        own = level.drop("above")
        up = top.select(F.col("grp").alias("up_grp"), F.col("at").alias("up_at"), F.col("path").alias("up_path"), *more)
        met = own.join(up, (F.col("grp") == F.col("up_grp")) & (F.col("up") == F.col("up_at")))
        top = met.select(*[c for c in own.columns if c not in ("up", "steps")], *more, F.concat("steps", "up_path").alias("path"))
    return top


def proofs(found: Manifest) -> DataFrame:
    """The leaves (id, node and what was kept beside them) with `subroot` and `path`. The
    steps of upper levels are handed down level by level; each level is a join on the
    parent, a third the size of the one below it."""
    none = F.array().cast("array<struct<before:string,behind:string>>")
    spark = found.rows[0].sparkSession
    start = spark.range(1).select(F.lit("").alias("grp"), F.col("id").alias("at"), none.alias("path"))  # the root itself
    groups = _down(found.groups, start).select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("at"), "path", F.col("node").alias("subroot"))
    return _down(found.rows, groups).drop("grp", "at")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, from the leaf up, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["behind"])), ""))


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf leads to by its path."""
    return F.aggregate(path, node, lambda acc, x: digest(F.concat(x["before"], acc, x["behind"])))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))
    altered = leaf([text if c == "text" else F.col(c) for c in COLUMNS])
    found = manifest(docs, also={"altered": altered})
    rows = proofs(found).withColumns({"root": F.lit(found.root).cast("string"), "folded_root": folded(F.col("altered"), F.col("path"))})
    return rows.select(F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


#: crc32 bit by bit: the bits of the decimal digits, lowest first, through the usual reversed polynomial.
_CRC = """list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(0, 8), lambda b: (ascii(c) >> b) & 1))),
  lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1)), CAST(4294967295 AS BIGINT))"""
_UP = "list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1:i + 3], '')))"

OP13_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
  CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS altered FROM documents),
q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS place, row_number() OVER () AS id FROM d),
s AS (SELECT coalesce('=' || source, '-') AS grp, 0 AS lev, list(leaf ORDER BY place) AS nodes FROM q GROUP BY source
  UNION ALL SELECT grp, lev + 1, {_UP} FROM s WHERE len(nodes) > 1),
subs AS (SELECT grp, nodes[1] AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place FROM s WHERE len(nodes) = 1),
t AS (SELECT 0 AS lev, list(subroot ORDER BY place) AS nodes FROM subs UNION ALL SELECT lev + 1, {_UP} FROM t WHERE len(nodes) > 1),
low AS (SELECT id, coalesce('=' || source, '-') AS grp, 0 AS lev, place AS pos, '' AS proof, altered AS acc FROM q
  UNION ALL SELECT id, low.grp, low.lev + 1, pos // 3, proof || array_to_string(list_concat(nodes[pos // 3 * 3 + 1:pos], nodes[pos + 2:pos // 3 * 3 + 3]), ''),
    sha256(array_to_string(nodes[pos // 3 * 3 + 1:pos], '') || acc || array_to_string(nodes[pos + 2:pos // 3 * 3 + 3], ''))
  FROM low JOIN s ON s.grp = low.grp AND s.lev = low.lev WHERE len(nodes) > 1),
mid AS (SELECT low.* FROM low JOIN s ON s.grp = low.grp AND s.lev = low.lev WHERE len(nodes) = 1),
high AS (SELECT id, 0 AS lev, place AS pos, proof, acc, subroot FROM mid JOIN subs USING (grp)
  UNION ALL SELECT id, high.lev + 1, pos // 3, proof || array_to_string(list_concat(nodes[pos // 3 * 3 + 1:pos], nodes[pos + 2:pos // 3 * 3 + 3]), ''),
    sha256(array_to_string(nodes[pos // 3 * 3 + 1:pos], '') || acc || array_to_string(nodes[pos + 2:pos // 3 * 3 + 3], '')), subroot
  FROM high JOIN t ON t.lev = high.lev WHERE len(nodes) > 1),
ends AS (SELECT high.*, nodes[1] AS root FROM high JOIN t ON t.lev = high.lev WHERE len(nodes) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM ends JOIN q USING (id)
"""
