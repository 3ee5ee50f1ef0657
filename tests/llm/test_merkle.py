import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, text=None):
    doc_id, own, lang, source, n_chars = row
    values = [doc_id, source, lang, n_chars, own if text is None else text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, fan_out):
    """All levels of the tree over nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan_out])) for i in range(0, len(levels[-1]), fan_out)])
    return levels


def plain_steps(levels, at, fan_out):
    steps = []
    for nodes in levels[:-1]:
        run = nodes[at // fan_out * fan_out :][:fan_out]
        steps.append(("".join(run[: at % fan_out]), "".join(run[at % fan_out + 1 :])))
        at //= fan_out
    return steps


def plain(rows, fan_out):
    """(doc_id, leaf, subroot, root, steps) of each row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is None, row[0] or 0, plain_leaf(row)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s])], fan_out) for s in order}
    above = plain_tree([trees[s][-1][0] for s in order], fan_out)
    out = []
    for place, s in enumerate(order):
        for at, (null, doc_id, leaf) in enumerate(sorted(groups[s])):
            steps = plain_steps(trees[s], at, fan_out) + plain_steps(above, place, fan_out)
            out.append((None if null else doc_id, leaf, trees[s][-1][0], above[-1][0], steps))
    return out


def documents(seed):
    rng = random.Random(seed)
    sources = ["a", "b", "", None, "é", "Z", *[f"s{i}" for i in range(rng.randrange(1, 8))]]
    rows = [(i, rng.choice(["x\ny", "", None, "ß" * 5, "-"]), rng.choice(["en", None]), "a" if rng.random() < 0.5 else rng.choice(sources), rng.choice([3, None, -1])) for i in range(70)]
    return [*rows, *rows[:4], (None, "n", "en", "a", 1), (None, None, None, None, None), (5, "again", "en", "a", 1), (900, "long \n" * 20000, "en", "alone", 9)]


@pytest.mark.parametrize("fan_out,seed", [(3, 1), (2, 2)])
def test_against_plain(spark, fan_out, seed):
    rows = documents(seed)
    found = merkle.manifest(spark.createDataFrame(rows, COLUMNS).repartition(3), fan_out=fan_out)
    want = plain(rows, fan_out)
    got = merkle.proofs(found).withColumns({"proof": merkle.proof_digest(F.col("path")), "end": merkle.folded(F.col("node"), F.col("path"))}).collect()
    tell = lambda x: sorted(x, key=repr)
    assert found.root == want[0][3]
    assert tell((r["id"], r["node"], r["subroot"], [tuple(s) for s in r["path"]]) for r in got) == tell((w[0], w[1], w[2], w[4]) for w in want)
    assert {r["end"] for r in got} == {found.root}
    assert tell(r["proof"] for r in got) == tell(sha("".join(a + b for a, b in w[4])) for w in want)


def test_tampering_shows(spark):
    """A changed text leads to another root; so do a changed null, a moved byte and another order."""
    rows = documents(3)
    docs = spark.createDataFrame(rows, COLUMNS)
    altered = merkle.leaf([F.coalesce(F.col(c), F.lit("")) if c == "text" else F.col(c) for c in merkle.COLUMNS])
    found = merkle.manifest(docs, also={"altered": altered, "null_text": F.col("text").isNull()})
    for r in merkle.proofs(found).withColumn("end", merkle.folded(F.col("altered"), F.col("path"))).collect():
        assert (r["end"] != found.root) == r["null_text"]
    moved = [(r[0], (r[1] or "") + "x", r[2], r[3], r[4]) if r[0] == 7 else r for r in rows]
    assert merkle.manifest(spark.createDataFrame(moved, COLUMNS)).root != found.root
    assert merkle.manifest(docs.repartition(7)).root == found.root


def test_small_and_odd_tables(spark):
    """No rows, one row, one source; text ids; names with dots and such as ours."""
    none = merkle.manifest(spark.createDataFrame([], COLUMNS))
    assert none.root is None and merkle.proofs(none).collect() == []
    one = [(1, "t", "en", "s", 1)]
    found = merkle.manifest(spark.createDataFrame(one, COLUMNS))
    row = merkle.proofs(found).first()
    assert found.root == row["node"] == row["subroot"] == plain_leaf(one[0]) and row["path"] == []
    df = spark.createDataFrame([("b", "g", 1, 2), ("a", "g", 3, 4), ("c", None, 5, 6)], "`my.id` string, grp string, at int, node int")
    odd = merkle.manifest(df, group_col="grp", id_col="my.id", columns=("my.id", "at", "node"))
    leaves = {x: sha(f"1:{x}1:{a}1:{n}") for x, a, n in (("b", 1, 2), ("a", 3, 4), ("c", 5, 6))}
    assert odd.root == sha(leaves["c"] + sha(leaves["a"] + leaves["b"]))
    assert [r["id"] for r in merkle.proofs(odd).orderBy("id").collect()] == ["a", "b", "c"]
