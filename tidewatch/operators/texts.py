"""Text rules: URLs, duplicates, advertising, keywords, similarity, vectors, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators import filtering
from tidewatch.sources.tables import table

# Kinds of risk and words of the documents' languages that stand for theirs.
KINDS = {
    "legal": ["thor", "une", "nicht"], "safety": ["erin", "dans", "ist"], "labour": ["stand", "avec"], "finance": ["anea", "sur"],
    "product": ["onan", "pour"], "privacy": ["token", "password", "key"], "governance": ["licensed", "licence"], "reputation": ["attion", "que", "las"],
}
# Query vectors of one block and vectors of one shard, over all labels.
BLOCK_QUERIES, SHARD_ROWS = 1_024, 2_048


def url_normalize(spark, sf_dir):
    """Page addresses for comparing, for keeping, and bare; and the domain."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.normalized_url(u).alias("plain"), T.canonical_url(u).alias("canonical"), T.bare_url(u).alias("bare"), T.source_domain(u).alias("domain"))


def source_domain_credibility(spark, sf_dir):
    """Pages of each domain and how far it is to be believed."""
    rows = table(spark, sf_dir, "pages").select(T.source_domain(F.when(F.col("page_id") % 10 != 0, F.col("url"))).alias("domain"))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("pages")).withColumn("credibility", T.credibility(F.col("domain")))


def content_hash_dedupe(spark, sf_dir):
    """The first document of each text, and how many share it."""
    rows = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash"))
    return rows.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def ad_rules_score(spark, sf_dir):
    """Advertising score of a document by the weighted rules, and its band."""
    rows = filtering.filter_ads(spark, sf_dir)
    band = F.when(F.col("ad_score") >= filtering.AD_REJECT, "reject").when(F.col("ad_score") >= filtering.AD_REVIEW, "review").otherwise("pass")
    return rows.select(F.col("raw_id").alias("doc_id"), "ad_score", band.alias("band"))


def keyword_share(spark, sf_dir):
    """Per language the share of documents that hold a word of each of eight kinds of
    risk, in normalised text, between other than letters and digits."""
    norm = T.normalized(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("lang", norm.alias("norm"))
    share = [F.round(F.avg(reduce(lambda a, b: a | b, [T.holds_term(F.col("norm"), w) for w in words]).cast("double")), 6).alias(f"share_{kind}") for kind, words in KINDS.items()]
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *share)


def jaccard_pairs(items, at_least=0.0):
    """All pairs a < b of items (item_id, words without repeats) that share a word and
    whose words have a Jaccard similarity of at_least. Words are put in order from the
    rarest; a similar pair shares one of the first n - ceil(at_least * n) + 1 of each
    side's n words, so only these make candidates, and all words verify them."""
    each = items.select("item_id", F.explode("words").alias("word"))
    ranked = each.join(each.groupBy("word").agg(F.count(F.lit(1)).alias("held")), "word")
    sets = ranked.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("held", "word"))), lambda x: x["word"]).alias("words"))
    least = F.greatest(F.ceil(F.size("words") * F.lit(float(at_least)) - 1e-9), F.lit(1))
    first = sets.select("item_id", F.explode(F.slice("words", F.lit(1), (F.size("words") - least + 1).cast("int"))).alias("word"))
    met = first.toDF("a", "word").join(first.toDF("b", "word"), "word").where("a < b").select("a", "b").distinct()
    full = met.join(sets.toDF("a", "words_a"), "a").join(sets.toDF("b", "words_b"), "b")
    both = F.size(F.array_intersect("words_a", "words_b"))
    jaccard = both / (F.size("words_a") + F.size("words_b") - both)
    return full.where(jaccard >= at_least - 1e-9).select("a", "b", F.round(jaccard, 6).alias("jaccard"))


def token_jaccard_pairs(spark, sf_dir):
    """Pairs of benchmark items that share a word of any length, with the Jaccard
    similarity of all their words."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \n]+"), lambda w: w != ""))
    return jaccard_pairs(table(spark, sf_dir, "benchmark").select("item_id", words.alias("words")))


def _top_five(queries, rows):
    """The five best of a shard's rows for each of a block's queries, scores rounded as
    in the SQL, the smaller vec_id first among equals."""
    import numpy as np
    import pyarrow as pa

    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not queries.num_rows or not rows.num_rows:
        return out.empty_table()
    rows = rows.sort_by("vec_id")
    unit = lambda t: (v := np.array(t.column("v").to_pylist(), dtype=np.float64)) / np.linalg.norm(v, axis=1, keepdims=True)
    ids, query_ids = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
    scores = np.floor(unit(queries) @ unit(rows).T * 1e6 + 0.5) / 1e6
    scores[query_ids[:, None] == ids[None, :]] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    found = np.take_along_axis(scores, best, axis=1)
    q, k = np.nonzero(found >= 0.2)
    return pa.Table.from_arrays([pa.array(query_ids[q]), pa.array(ids[best[q, k]]), pa.array(found[q, k])], schema=out)


def vector_relative_cut_all(spark, sf_dir):
    """For each vector whose id is divisible by 50: the vectors of the same label with
    cosine of at least 0.2, at most five, none below 0.92 of the best. Blocks of queries
    meet shards of rows, and the shards' best are merged."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v")).where("label IS NOT NULL AND embedding IS NOT NULL")
    n = rows.count()
    shards, blocks = -(-n // SHARD_ROWS) or 1, -(-n // (50 * BLOCK_QUERIES)) or 1
    part = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<long>"))
    queries = rows.where("vec_id % 50 = 0").withColumn("block", part(blocks)).withColumn("shard", each(shards))
    sharded = rows.withColumn("shard", part(shards)).withColumn("block", each(blocks))
    keys = ["label", "block", "shard"]
    scored = queries.groupBy(*keys).cogroup(sharded.groupBy(*keys)).applyInArrow(_top_five, "query_id long, vec_id long, score double")
    of = Window.partitionBy("query_id")
    ranked = scored.withColumn("rank", F.row_number().over(of.orderBy(F.desc("score"), "vec_id")).cast("long")).where("rank <= 5").withColumn("best", F.max("score").over(of))
    return ranked.where("score >= 0.92 * best").select("query_id", "rank", "vec_id", "score")


def first_turn_of_conversation(spark, sf_dir):
    """First and last turn, turns by role, per conversation."""
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.min_by("text", "turn").alias("first_text"), F.max("turn").alias("last_turn"))


def binary_metrics(spark, sf_dir):
    """Counts, precision, recall and accuracy of a rule against the quality labels."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("quality") == 1, ~F.contains("text", F.lit("!!"))).toDF("y", "p")
    tp, fp, fn, tn = (F.count_if(c) for c in (F.col("y") & F.col("p"), ~F.col("y") & F.col("p"), F.col("y") & ~F.col("p"), ~F.col("y") & ~F.col("p")))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp + tn, F.count(F.lit(1))).alias("accuracy"))


def rank_auc(spark, sf_dir):
    """Area under the curve of text length as a score of quality, ties at half; null if
    one class is missing."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("n_chars").alias("s"), F.col("quality").alias("y"))
    by = rows.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = by.withColumn("won", F.col("pos") * (below + F.col("neg") * 0.5))
    pairs = F.sum("pos") * F.sum("neg")
    return won.agg(F.round(F.when(pairs > 0, F.sum("won") / pairs), 6).alias("auc"))


def threshold_grid(spark, sf_dir):
    """F2 of each threshold of a grid, from one pass of counts by grid cell."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.floor(F.least(F.col("n_chars") / 200, F.lit(20))).alias("cell"), F.col("quality").alias("y"))
    by = rows.groupBy("cell").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("pos").over(Window.partitionBy(F.lit(1)))
    tp, taken = F.sum("pos").over(above), F.sum("n").over(above)
    return by.select("cell", tp.alias("tp"), taken.alias("taken"), F.round(5 * tp / (4 * total + taken), 6).alias("f2"))


QUERIES = {f.__name__: f for f in (url_normalize, source_domain_credibility, content_hash_dedupe, ad_rules_score, keyword_share, token_jaccard_pairs, vector_relative_cut_all, first_turn_of_conversation, binary_metrics, rank_auc, threshold_grid)}

_LABELLED = "SELECT d.*, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id"
ORACLE_SQL = {
    "url_normalize": f"SELECT page_id, {T.normalized_url_sql('url')} AS plain, {T.canonical_url_sql('url')} AS canonical, {T.bare_url_sql('url')} AS bare, {T.source_domain_sql('url')} AS domain FROM pages",
    "source_domain_credibility": f"WITH d AS (SELECT {T.source_domain_sql('CASE WHEN page_id % 10 <> 0 THEN url END')} AS domain FROM pages) SELECT domain, count(*) AS pages, {T.credibility_sql('domain')} AS credibility FROM d GROUP BY domain",
    "content_hash_dedupe": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "ad_rules_score": f"SELECT raw_id AS doc_id, ad_score, CASE WHEN ad_score >= {filtering.AD_REJECT}::DOUBLE THEN 'reject' WHEN ad_score >= {filtering.AD_REVIEW}::DOUBLE THEN 'review' ELSE 'pass' END AS band FROM ({filtering.ORACLE_SQL['filter_ads']})",
    "keyword_share": f"WITH n AS (SELECT lang, {T.normalized_sql('text')} AS norm FROM documents) SELECT lang, count(*) AS n, " + ", ".join(f"round(avg(({' OR '.join(T.holds_term_sql('norm', w) for w in words)})::INT), 6) AS share_{kind}" for kind, words in KINDS.items()) + " FROM n GROUP BY lang",
    "token_jaccard_pairs": r"""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \n]+'), lambda w: w <> '')) AS words FROM benchmark)
      SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))), 6) AS jaccard FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(list_intersect(a.words, b.words)) > 0""",
    "vector_relative_cut_all": """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
      s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e JOIN e q ON q.label = e.label AND q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM s WHERE score >= 0.2)
      SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5 AND score >= 0.92 * best""",
    "first_turn_of_conversation": "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, arg_min(text, turn) AS first_text, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "binary_metrics": f"""WITH r AS (SELECT quality = 1 AS y, NOT contains(text, '!!') AS p FROM ({_LABELLED})), c AS (SELECT count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM r)
      SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""",
    "rank_auc": f"""WITH r AS (SELECT n_chars AS s, quality AS y FROM ({_LABELLED}))
      SELECT round((SELECT sum(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0 END) FROM r a JOIN r b ON a.y = 1 AND b.y = 0) / nullif((SELECT count(*) FROM r WHERE y = 1) * (SELECT count(*) FROM r WHERE y = 0), 0), 6) AS auc""",
    "threshold_grid": f"""WITH r AS (SELECT CAST(floor(least(n_chars / 200, 20)) AS BIGINT) AS cell, quality AS y FROM ({_LABELLED})), g AS (SELECT DISTINCT cell FROM r)
      SELECT cell, CAST((SELECT sum(y) FROM r WHERE r.cell >= g.cell) AS BIGINT) AS tp, (SELECT count(*) FROM r WHERE r.cell >= g.cell) AS taken,
      round(5 * (SELECT sum(y) FROM r WHERE r.cell >= g.cell) / (4 * (SELECT sum(y) FROM r) + (SELECT count(*) FROM r WHERE r.cell >= g.cell)), 6) AS f2 FROM g""",
}
