"""Order lines that meet their orders in tasks of bounded size."""

import re

import duckdb
from conftest import SF, same

from tidewatch.operators import intervals


def test_tasks_grow_with_the_lines(spark, duck, monkeypatch):
    """Rows that a task sorts and counts do not depend on the number of shuffle partitions."""
    monkeypatch.setattr(intervals, "LINES_A_TASK", 500, raising=False)
    found = intervals.foreign_references(spark, SF)
    lines = duck.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    dealt = re.findall(r"hashpartitioning\(\w_orderkey#\d+L, (\d+)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt == [str(-(-lines // 500))] * 2 and lines > 2000
    same(found, duck, intervals.ORACLE_SQL["foreign_references"])


def test_repeated_and_missing_keys(spark, tmp_path):
    """Orders, customers and suppliers that stand twice, keys and nations that are null."""
    tables = {
        "lineitem": ("l_orderkey long, l_suppkey long", [(1, 1), (1, 2), (1, 2), (2, 1), (2, 3), (3, 2), (None, 1), (4, None), (9, 1)]),
        "orders": ("o_orderkey long, o_custkey long", [(1, 1), (1, 1), (1, 2), (2, 2), (3, 3), (4, 1), (None, 1)]),
        "customer": ("c_custkey long, c_nationkey int", [(1, 5), (2, 6), (2, 7), (3, None)]),
        "supplier": ("s_suppkey long, s_nationkey int", [(1, 5), (2, 6), (2, 8), (3, None)]),
    }
    base = duckdb.connect()
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        base.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    same(intervals.foreign_references(spark, str(tmp_path)), base, intervals.ORACLE_SQL["foreign_references"])
