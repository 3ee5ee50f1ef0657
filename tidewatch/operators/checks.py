"""Data checks and changes of tables: violations, ownership, upserts, clean-up, backups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.filtering import ORACLE_SQL as FILTER_SQL
from tidewatch.operators.filtering import filter_stages
from tidewatch.sources.tables import ARTICLES_SQL, articles, table


def _tagged(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("rule", F.lit(name)) for name, df in frames.items()])


def decision_violations(spark, sf_dir):
    """Decisions that break a rule of their table: reason and decision go together, a
    duplicate names another item, scores are shares. Decisions are tampered with for some
    ids, so that there is something to find."""
    i = F.col("raw_id")
    rows = filter_stages(spark, sf_dir).withColumns({
        "decision": F.when(i % 41 == 0, "accepted").otherwise(F.col("decision")), "duplicate_of": F.when(i % 43 == 0, i).otherwise(F.col("duplicate_of")),
        "relevance": F.when(i % 47 == 0, 1.5).otherwise(F.col("relevance")), "confidence": F.when(i % 53 == 0, -0.1).otherwise(F.col("confidence")), "reason": F.when(i % 59 == 0, "spam").otherwise(F.col("reason")),
    })
    accepted, duplicate = F.col("decision") == "accepted", F.col("reason") == "duplicate"
    pairing = (accepted & F.col("reason").isin("accepted", "duplicate")) | (~accepted & (F.col("reason") != "accepted"))
    share = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(True))
    rules = {
        "reason_known": F.col("reason").isin("duplicate", "advertisement", "irrelevant", "accepted"), "decision_reason": pairing,
        "duplicate_not_self": F.coalesce(F.col("duplicate_of") != i, F.lit(True)), "duplicate_reason": duplicate == F.col("duplicate_of").isNotNull(),
        "relevance_share": share("relevance"), "advertising_share": share("ad_score"), "confidence_share": share("confidence"),
    }
    broken = F.explode(F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])))
    return rows.select("raw_id", broken.alias("rule"))


def label_violations(spark, sf_dir):
    """Labels with a value that is none, without a document, or with two answers; and users
    with more than one main company."""
    labels = table(spark, sf_dir, "labels")
    odd = labels.where(~F.col("quality").isin(0, 1) | ~F.col("toxic").isin(0, 1)).select("doc_id")
    orphan = labels.join(table(spark, sf_dir, "documents"), "doc_id", "left_anti").select("doc_id")
    twice = labels.groupBy("doc_id").agg(F.countDistinct("quality").alias("n")).where("n > 1").select("doc_id")
    mains = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).count().where("count > 1").select("doc_id")
    return _tagged({"unknown_value": odd, "no_document": orphan, "two_answers": twice, "two_main_companies": mains}).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


def mixed_owners(spark, sf_dir):
    """Keys that six tables use: those whose rows do not have exactly one owner."""
    t = lambda name: table(spark, sf_dir, name)
    refs = [t("customer").select(F.col("c_nationkey").alias("key")), t("supplier").select("s_nationkey"), t("nation").select("n_nationkey"), t("region").select("r_regionkey"), t("part").select("p_size"), t("orders").select((F.col("o_custkey") % 60).cast("int"))]
    keys = reduce(DataFrame.union, refs).distinct()
    owners = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("owner")).union(t("supplier").select("s_nationkey", (F.col("s_suppkey") % 2).cast("int")))
    return keys.join(owners, "key", "left").groupBy("key").agg(F.countDistinct("owner").alias("owners")).where("owners <> 1")


def owner_checks(spark, sf_dir):
    """The smallest owner of each group, and all references that belong to another one,
    tagged by where they stand."""
    first = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("owner"))
    of_orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(first, "c_nationkey").where(F.col("o_custkey") % 500 != F.col("owner") % 500).select("c_nationkey", "owner")
    of_suppliers = table(spark, sf_dir, "supplier").join(first, F.col("s_nationkey") == F.col("c_nationkey")).where(F.col("s_suppkey") != F.col("owner")).select("c_nationkey", "owner")
    return _tagged({"orders": of_orders, "suppliers": of_suppliers}).groupBy("rule", "c_nationkey", "owner").agg(F.count(F.lit(1)).alias("n"))


def unowned_rows(spark, sf_dir):
    """Rows of three sources that no document stands behind, by source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    found = _tagged({"pages": table(spark, sf_dir, "pages").select((F.col("page_id") * 5).alias("key")), "conversations": table(spark, sf_dir, "conversations").select((F.col("conv_id") * 11).alias("key")), "labels": table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"))})
    return found.join(docs, "key", "left_anti").groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


def first_member(spark, sf_dir):
    """The first row of each key by time and id, and the columns it brings."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(order)).where("n = 1").select("o_custkey", "o_orderkey", "o_orderdate")


def known_types(spark, sf_dir):
    """Of a company's event types those that are in the list, in its order."""
    listed = F.array(*map(F.lit, ("purchase", "error", "refund", "view")))
    rows = articles(spark, sf_dir).where("story % 4 = company_id % 4").groupBy("company_id").agg(F.collect_set("source").alias("types"))
    return rows.select("company_id", F.array_join(F.array_intersect(listed, F.col("types")), ",").alias("types"), F.array_join(F.array_sort(F.array_except("types", listed)), ",").alias("unknown"))


def upserted_queries(spark, sf_dir):
    """A counter table after a batch: counts add up where the key is there, new keys get a
    row with the next number in order of their name."""
    rows = articles(spark, sf_dir).withColumn("key", F.concat_ws("-", "source", "company_id"))
    stored = rows.where("article_id % 3 = 0 AND company_id < 40").groupBy("key").agg(F.count(F.lit(1)).alias("hits"), F.min("article_id").alias("id"))
    batch = rows.where("article_id % 3 = 1").groupBy("key").agg(F.count(F.lit(1)).alias("more"))
    merged = stored.join(batch, "key", "full").withColumn("hits", F.coalesce("hits", F.lit(0)) + F.coalesce("more", F.lit(0)))
    new = merged.where("id IS NULL").select("key", F.row_number().over(Window.orderBy("key")).cast("long").alias("number"))  # only keys that are new in a batch
    top = merged.agg(F.max("id").alias("top"))
    numbered = merged.join(new, "key", "left").crossJoin(F.broadcast(top))  # one row
    return numbered.select("key", "hits", F.coalesce("id", F.col("top") + F.col("number")).alias("id"))


def cascade_delete(spark, sf_dir):
    """What is left after companies are deleted: their orders and lines go, and parts that
    only these lines named."""
    gone = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").join(gone, "o_custkey", "left_anti")
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    named = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    orphans = named.join(lines.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")
    parts = table(spark, sf_dir, "part").join(orphans, "p_partkey", "left_anti")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(name))
    return count(orders, "orders").unionByName(count(lines, "lines")).unionByName(count(parts, "parts"))


def bulk_update(spark, sf_dir):
    """Orders with their status set from a join, and how many rows that changed, by the
    status before."""
    late = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_linestatus") == "O").alias("open"))
    rows = table(spark, sf_dir, "orders").join(late, "o_orderkey", "left")
    new = F.when(F.col("open"), "O").when(~F.col("open"), "F").otherwise(F.col("o_orderstatus"))
    return rows.withColumn("new", new).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("new") != F.col("o_orderstatus")).alias("changed"))


def review_versions(spark, sf_dir):
    """Reviews as versions that never change: each one's number, whether it is the last,
    and what it put in place of what."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    back = Window.partitionBy("l_orderkey").orderBy(*[F.desc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")])
    rows = table(spark, sf_dir, "lineitem").withColumns({"version": F.row_number().over(order), "before": F.lag("l_returnflag").over(order), "rest": F.row_number().over(back)})
    return rows.groupBy("version", "before", F.col("l_returnflag").alias("label"), (F.col("rest") == 1).alias("current")).agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.col("version").cast("long"))


def read_markers(spark, sf_dir):
    """Markers to add for notifications that a user has not read yet: those there stay."""
    rows = articles(spark, sf_dir).where("negative >= 0.66").select("company_id", "story").distinct()
    read = articles(spark, sf_dir).where("source = 'purchase'").select("company_id", "story").distinct()
    return rows.join(read, ["company_id", "story"], "left_anti")


def row_backup(spark, sf_dir):
    """Full rows as JSON before a change, told by their digests."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct("s_suppkey", "s_name", "s_nationkey")).alias("row"))
    return rows.select("s_suppkey", F.md5("row").alias("digest"), F.char_length("row").cast("long").alias("n_chars"))


def daily_report(spark, sf_dir):
    """One report for each Seoul date, however often it was made: the last one made counts."""
    rows = articles(spark, sf_dir).withColumn("day", F.to_date(F.col("seen_at") + F.expr("INTERVAL 9 HOURS")))
    runs = rows.groupBy("day", (F.col("article_id") % 3).alias("run")).agg(F.count(F.lit(1)).alias("articles"), F.round(F.avg("negative"), 6).alias("mean_negative"))
    return runs.groupBy("day").agg(F.max_by(F.struct("articles", "mean_negative"), "run").alias("r")).select("day", "r.*")


QUERIES = {f.__name__: f for f in (decision_violations, label_violations, mixed_owners, owner_checks, unowned_rows, first_member, known_types, upserted_queries, cascade_delete, bulk_update, review_versions, read_markers, row_backup, daily_report)}

_VERSION = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
ORACLE_SQL = {
    "decision_violations": f"""WITH s AS ({FILTER_SQL['filter_stages']}), r AS (SELECT raw_id, CASE WHEN raw_id % 41 = 0 THEN 'accepted' ELSE decision END AS decision, CASE WHEN raw_id % 43 = 0 THEN raw_id ELSE duplicate_of END AS duplicate_of, CASE WHEN raw_id % 47 = 0 THEN 1.5 ELSE relevance END AS relevance, ad_score, CASE WHEN raw_id % 53 = 0 THEN -0.1 ELSE confidence END AS confidence, CASE WHEN raw_id % 59 = 0 THEN 'spam' ELSE reason END AS reason FROM s)
      SELECT raw_id, 'reason_known' AS rule FROM r WHERE reason NOT IN ('duplicate', 'advertisement', 'irrelevant', 'accepted') UNION ALL SELECT raw_id, 'decision_reason' FROM r WHERE NOT ((decision = 'accepted' AND reason IN ('accepted', 'duplicate')) OR (decision <> 'accepted' AND reason <> 'accepted')) UNION ALL SELECT raw_id, 'duplicate_not_self' FROM r WHERE duplicate_of = raw_id
      UNION ALL SELECT raw_id, 'duplicate_reason' FROM r WHERE (reason = 'duplicate') <> (duplicate_of IS NOT NULL) UNION ALL SELECT raw_id, 'relevance_share' FROM r WHERE relevance NOT BETWEEN 0 AND 1 UNION ALL SELECT raw_id, 'advertising_share' FROM r WHERE ad_score NOT BETWEEN 0 AND 1 UNION ALL SELECT raw_id, 'confidence_share' FROM r WHERE confidence NOT BETWEEN 0 AND 1""",
    "label_violations": """WITH v AS (SELECT 'unknown_value' AS rule, doc_id FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1) UNION ALL SELECT 'no_document', doc_id FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT 'two_answers', doc_id FROM labels GROUP BY doc_id HAVING count(DISTINCT quality) > 1
      UNION ALL SELECT 'two_main_companies', CAST(c_nationkey AS BIGINT) FROM customer WHERE c_custkey % 10 = 0 GROUP BY c_nationkey HAVING count(*) > 1) SELECT rule, count(*) AS n, min(doc_id) AS first FROM v GROUP BY rule""",
    "mixed_owners": """WITH k AS (SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation UNION SELECT r_regionkey FROM region UNION SELECT p_size FROM part UNION SELECT CAST(o_custkey % 60 AS INT) FROM orders), o AS (SELECT n_nationkey AS key, n_regionkey AS owner FROM nation UNION ALL SELECT s_nationkey, CAST(s_suppkey % 2 AS INT) FROM supplier)
      SELECT key, count(DISTINCT owner) AS owners FROM k LEFT JOIN o USING (key) GROUP BY key HAVING count(DISTINCT owner) <> 1""",
    "owner_checks": """WITH f AS (SELECT c_nationkey, min(c_custkey) AS owner FROM customer GROUP BY 1) SELECT 'orders' AS rule, c_nationkey, owner, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN f USING (c_nationkey) WHERE o_custkey % 500 <> owner % 500 GROUP BY ALL
      UNION ALL SELECT 'suppliers', c_nationkey, owner, count(*) FROM supplier JOIN f ON s_nationkey = c_nationkey WHERE s_suppkey <> owner GROUP BY ALL""",
    "unowned_rows": """WITH r AS (SELECT 'pages' AS rule, page_id * 5 AS key FROM pages UNION ALL SELECT 'conversations', conv_id * 11 FROM conversations UNION ALL SELECT 'labels', doc_id FROM labels) SELECT rule, count(*) AS n, count(DISTINCT key) AS keys FROM r WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = key) GROUP BY rule""",
    "first_member": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey",
    "known_types": f"""WITH {ARTICLES_SQL}, t AS (SELECT company_id, list(DISTINCT source) AS types FROM articles WHERE story % 4 = company_id % 4 GROUP BY 1) SELECT company_id, array_to_string(list_filter(['purchase', 'error', 'refund', 'view'], lambda x: list_contains(types, x)), ',') AS types, array_to_string(list_sort(list_filter(types, lambda x: x NOT IN ('purchase', 'error', 'refund', 'view'))), ',') AS unknown FROM t""",
    "upserted_queries": f"""WITH {ARTICLES_SQL}, r AS (SELECT *, source || '-' || company_id AS key FROM articles), s AS (SELECT key, count(*) AS hits, min(article_id) AS id FROM r WHERE article_id % 3 = 0 AND company_id < 40 GROUP BY 1), b AS (SELECT key, count(*) AS more FROM r WHERE article_id % 3 = 1 GROUP BY 1),
      m AS (SELECT key, coalesce(hits, 0) + coalesce(more, 0) AS hits, id FROM s FULL JOIN b USING (key)) SELECT key, hits, coalesce(id, (SELECT max(id) FROM m) + row_number() OVER (PARTITION BY id IS NULL ORDER BY key)) AS id FROM m""",
    "cascade_delete": """WITH o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), d AS (SELECT DISTINCT l_partkey FROM lineitem EXCEPT SELECT l_partkey FROM l)
      SELECT 'orders' AS rule, count(*) AS n FROM o UNION ALL SELECT 'lines', count(*) FROM l UNION ALL SELECT 'parts', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM d)""",
    "bulk_update": """WITH l AS (SELECT l_orderkey, bool_or(l_linestatus = 'O') AS is_open FROM lineitem GROUP BY 1), r AS (SELECT o_orderstatus, CASE WHEN is_open THEN 'O' WHEN NOT is_open THEN 'F' ELSE o_orderstatus END AS new FROM orders LEFT JOIN l ON o_orderkey = l_orderkey) SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE new <> o_orderstatus) AS changed FROM r GROUP BY 1""",
    "review_versions": f"""WITH r AS (SELECT row_number() OVER w AS version, lag(l_returnflag) OVER w AS before, l_returnflag AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in _VERSION.split(', '))}) = 1 AS current FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_VERSION})) SELECT version, before, label, current, count(*) AS n FROM r GROUP BY ALL""",
    "read_markers": f"WITH {ARTICLES_SQL} SELECT DISTINCT company_id, story FROM articles WHERE negative >= 0.66::DOUBLE EXCEPT SELECT company_id, story FROM articles WHERE source = 'purchase'",
    "row_backup": """WITH r AS (SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}' AS row FROM supplier) SELECT s_suppkey, md5(row) AS digest, CAST(length(row) AS BIGINT) AS n_chars FROM r""",
    "daily_report": f"""WITH {ARTICLES_SQL}, r AS (SELECT CAST(seen_at + INTERVAL 9 HOURS AS DATE) AS day, article_id % 3 AS run, count(*) AS articles, round(avg(negative), 6) AS mean_negative FROM articles GROUP BY ALL) SELECT day, articles, mean_negative FROM r QUALIFY row_number() OVER (PARTITION BY day ORDER BY run DESC) = 1""",
}
