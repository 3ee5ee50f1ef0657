"""Incidents from counts of slots: the work on messages, and odd attempts."""

import datetime as dt

import duckdb
from conftest import SF, same

from tidewatch.operators import lifecycle

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def test_messages_are_masked_once(spark):
    """A message is masked and searched in steps; attempts do not meet themselves for their codes."""
    for query in (lifecycle.incident_slots, lifecycle.error_sanitize):
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(authorization)") == 1 and "attempt_id = " not in plan and "exists(" not in plan


def test_odd_attempts(spark, tmp_path):
    """Repeated and negative numbers, slots of several failures, unknown outcomes and companies."""
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(i, c, s, 1.0, day(d), p) for i, c, s, d, p in [
        (1, 1, "F", 1, "a"), (1, 1, "O", 1, "b"), (1, 1, "F", 1, "a"), (2, 1, "F", 1, "b"), (4, 1, "F", 2, "a"), (-1, 1, "F", 3, "a"), (-3, 1, "F", 3, "b"), (-8, 1, "F", 4, "a"),
        (9, 1, "F", 5, "a"), (17, 1, "F", 6, "a"), (25, 1, "F", 7, "a"), (33, 1, "F", 8, "a"), (40, 1, "O", 7, "a"), (41, 2, None, 1, "a"), (42, 2, "F", 1, "a"), (43, None, "F", 1, "a"), (44, None, "O", 2, "a"), (45, 3, "O", 1, "a"),
    ]]
    spark.createDataFrame(rows, ORDERS).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    for name in ("incident_slots", "error_sanitize"):
        same(lifecycle.QUERIES[name](spark, str(tmp_path)), base, lifecycle.ORACLE_SQL[name])
