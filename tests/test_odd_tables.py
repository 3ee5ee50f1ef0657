"""All queries on empty tables, and on tables that hold nulls."""

import pytest
from conftest import SF

from tidewatch import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A key column of each table stays, so that a null row is a row.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id"}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    where = tmp_path_factory.mktemp("odd")
    for name in TABLES:
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        rows.limit(0).coalesce(1).write.parquet(f"{where}/empty/{name}.parquet")
        nulls = rows.limit(3).select(*[F.col(c) if c == KEYS[name] else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
        rows.limit(20).unionByName(nulls).coalesce(1).write.parquet(f"{where}/nulls/{name}.parquet")
    yield where
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_on_odd_tables(spark, odd, name):
    query = catalog.QUERIES[name]
    assert len(query(spark, f"{odd}/empty").collect()) <= 13
    query(spark, f"{odd}/nulls").collect()
