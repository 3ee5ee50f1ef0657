"""Rules that prepare a response: kinds of risk, regulations, cases, checks of a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.sources.tables import ARTICLES_SQL, articles, table

#: Thirteen kinds of risk and words of the documents that stand for theirs.
TYPES = {
    "R01": ["thor"], "R02": ["erin"], "R03": ["stand"], "R04": ["anea"], "R05": ["onan"], "R06": ["erble"], "R07": ["attion"], "R08": ["queau", "une"], "R09": ["nicht"], "R10": ["las"], "R11": ["token"], "R12": ["licensed"], "R13": ["than"],
}
# The kind that words alone never decide, hits it takes and how far ahead (fixed values).
NEVER_BY_WORDS, LEAST_HITS, TIMES_AHEAD = "R13", 3, 2
# Margin under which two kinds both stay, confidence under which someone looks (fixed values).
AMBIGUOUS_MARGIN, REVIEW_BELOW = 0.15, 0.5
# Tiers by probability band and sensitivity, from T1 to T3 (fixed values).
TIER = {("high", "high"): 3, ("high", "medium"): 3, ("high", "low"): 2, ("mid", "high"): 3, ("mid", "medium"): 2, ("mid", "low"): 2, ("low", "high"): 2, ("low", "medium"): 1, ("low", "low"): 1}
# A report's limits (fixed values).
MOST_STRATEGIES, MOST_RISKS, MOST_HOURS = 3, 2, 72


def type_hits(spark, sf_dir):
    """Per source the number of documents that hold a word of each kind, and the route:
    words decide if the first has three hits and twice the second's, and is not the kind
    that words never decide."""
    norm = T.normalized(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("source", norm.alias("norm"))
    hits = {k: F.count_if(reduce(lambda a, b: a | b, [T.holds_term(F.col("norm"), w) for w in words])) for k, words in TYPES.items()}
    by = rows.groupBy("source").agg(*[v.alias(k) for k, v in hits.items()])
    ranked = F.array_sort(F.array(*[F.struct((-F.col(k)).alias("n"), F.lit(k).alias("k")) for k in TYPES]))
    top, second = ranked.getItem(0), ranked.getItem(1)
    decisive = (-top["n"] >= LEAST_HITS) & (-top["n"] >= -second["n"] * TIMES_AHEAD) & (top["k"] != NEVER_BY_WORDS)
    return by.select("source", top["k"].alias("kind"), (-top["n"]).alias("hits"), (-second["n"]).alias("second_hits"), F.when(decisive, "keyword").otherwise("fallback").alias("route"))


def _type_scores(negative: Column, i: Column) -> list[Column]:
    """Three kinds' scores of an article, in thousandths."""
    return [F.floor((i * 37) % 1000), F.floor((i * 61) % 1000), F.floor(negative * 1000).cast("long")]


def ambiguous_types(spark, sf_dir):
    """An article's first kind by score, the second too if it is close, and the confidence,
    which is at most the detection's; someone looks if that is low."""
    scores = _type_scores(F.col("negative"), F.col("article_id"))
    names = ["legal", "safety", "finance"]
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(zip(names, scores))]))
    rows = articles(spark, sf_dir).withColumn("r", ranked)
    top, second = -F.col("r")[0]["s"], -F.col("r")[1]["s"]
    both = top - second < AMBIGUOUS_MARGIN * 1000
    confidence = F.least(top / 1000, 0.5 + F.col("negative") / 2)
    return rows.select("article_id", F.col("r")[0]["n"].alias("parent"), F.when(both, F.col("r")[1]["n"]).alias("other"), F.round(confidence, 6).alias("confidence"), (confidence < REVIEW_BELOW).alias("needs_review"))


def article_assessments(spark, sf_dir):
    """Risk of an article: a fifth its kind's score, seven tenths negativity, a tenth
    relevance; risk, none or uncertain. A model's score of the kind counts only where a
    word was hit or the article is negative, and not less than six tenths of the words'."""
    i, negative = F.col("article_id"), F.col("negative")
    words, model = (i * 37) % 1000 / 1000, (i * 61) % 1000 / 1000
    kind = F.when((words >= 0.5) | (negative >= 0.55), model * F.greatest(words, F.lit(0.6))).otherwise(words * 0.3)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), kind * 0.20 + negative * 0.70 + (i % 10) / 10 * 0.10))
    rows = articles(spark, sf_dir).withColumns({"kind": kind, "p": p})
    decision = F.when((F.col("kind") < 0.20) | (F.col("p") < 0.30), "non_risk").when((F.col("p") >= 0.60) & (F.col("kind") >= 0.35), "risk").otherwise("uncertain")
    return rows.select("article_id", F.round("kind", 6).alias("kind_score"), F.round("p", 6).alias("probability"), decision.alias("decision"))


def event_types(spark, sf_dir):
    """Of each story the largest score of each kind, as text in order of kinds, the first
    kind (ties by the taxonomy's order), and the time of its second risk article."""
    names = ["legal", "safety", "finance"]
    rows = articles(spark, sf_dir).select("company_id", "story", "seen_at", "article_id", "negative", *[s.alias(n) for n, s in zip(names, _type_scores(F.col("negative"), F.col("article_id")))])
    second = F.try_element_at(F.array_sort(F.collect_list(F.when(F.col("negative") >= 0.5, F.col("seen_at")))), F.lit(2))
    by = rows.groupBy("company_id", "story").agg(*[F.max(n).alias(n) for n in names], second.alias("qualified_at"))
    best = F.array_max(F.array(*[F.struct(F.col(n).alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n")) for i, n in enumerate(names)]))
    told = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])
    return by.select("company_id", "story", told.alias("scores"), best["n"].alias("primary_type"), "qualified_at")


def regulations(spark, sf_dir):
    """Verified rules in force on a date, and upcoming ones, whose deadline does not count
    yet: parts stand for rules, their type's first word for the kind."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").getItem(0).alias("kind"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("p_partkey") % 500).cast("int")).alias("from_day"), (F.col("p_size") > 5).alias("verified"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("hours"))
    upcoming = F.col("from_day") > F.lit("2024-01-31").cast("date")
    return rows.where("verified").select("p_partkey", "kind", upcoming.alias("upcoming"), F.when(~upcoming, F.col("hours")).alias("deadline_hours"))


def report_violations(spark, sf_dir):
    """Reports that break a rule: orders stand for reports, their lines for what they cite
    and plan. One row for each broken rule."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("cited"), F.count_if(F.col("l_returnflag") == "R").alias("strategies"), F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey") % 7)).alias("primary"), F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey") % 7)).alias("secondary"), F.max("l_quantity").alias("hours"), F.bool_or(F.col("l_linestatus") == "F").alias("denies"))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    preventable = F.col("o_orderpriority").startswith("1")
    rules = {
        "cites_unknown": F.exists("cited", lambda p: p % 97 == 0), "denies_preventable": preventable & F.col("denies"), "too_many_strategies": F.col("strategies") > MOST_STRATEGIES, "too_many_risks": F.size("primary") > MOST_RISKS,
        "risk_on_both_sides": F.size(F.array_intersect("primary", "secondary")) > 0, "deadline_out_of_range": ~F.col("hours").between(1, MOST_HOURS / 2),
    }
    return rows.select("o_orderkey", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(k)) for k, bad in rules.items()]))).alias("rule"))


def leak_marks(spark, sf_dir):
    """Documents in which names with underscores or addresses of the web stand open, and
    how many of each; whether one of their titles is in Hangul."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    snake, url = F.regexp_count("text", F.lit("[a-z]+_[a-z_]+")), F.regexp_count("text", F.lit("https?://[^ \\t\\n\\r]+|[a-z0-9.]+@[a-z0-9.-]+"))
    return rows.select("doc_id", snake.cast("long").alias("snake"), url.cast("long").alias("urls"), F.substring_index("text", "\n", 1).rlike("[가-힣]").alias("hangul")).where("snake + urls > 0")


def case_retrieval(spark, sf_dir):
    """Five cases for each label's first vector ids: curated ones first (id divisible by 7),
    filled up by the others, none of the same address or event (same id modulo 11)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), "label")
    asks = rows.groupBy("label").agg(F.min("case_id").alias("ask"))
    met = rows.join(F.broadcast(asks), "label").where((F.col("case_id") != F.col("ask")) & (F.col("case_id") % 11 != F.col("ask") % 11))  # a row a label
    order = Window.partitionBy("label").orderBy((F.col("case_id") % 7 == 0).desc(), "case_id")
    return met.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("label", F.col("rank").cast("long").alias("rank"), "case_id", (F.col("case_id") % 7 == 0).alias("curated"))


def same_event(spark, sf_dir):
    """Pairs of benchmark items whose distinct words overlap by a fifth of the smaller set (a
    half would find none there) and three at least, words of three letters or more,
    without a final particle. Items meet on a shared word; both sets are compared whole."""
    stem = lambda w: F.regexp_replace(w, "(?:ing|ed|s)$", "")
    words = F.array_distinct(F.filter(F.transform(T.tokens(T.normalized(F.col("text"))), stem), lambda w: F.char_length(w) >= 3))
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    each = rows.select("item_id", F.explode("w").alias("word"))
    met = each.toDF("a", "word").join(each.toDF("b", "word"), "word").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both")).where("both >= 3")
    full = met.join(rows.toDF("a", "wa"), "a").join(rows.toDF("b", "wb"), "b")
    overlap = F.col("both") / F.nullif(F.least(F.size("wa"), F.size("wb")), F.lit(0))  # ids may repeat
    return full.where(overlap >= 0.2).select("a", "b", F.round(overlap, 6).alias("overlap"))


def routed_events(spark, sf_dir):
    """Events of competitors are answered for their user's main company; an answer is made
    anew unless one of the same kind is there that is no older than the last revision."""
    rows = articles(spark, sf_dir).groupBy("company_id", "story").agg(F.max("negative").alias("p"), F.max("article_id").alias("revision"), F.min("article_id").alias("answered"), F.max_by("source", "article_id").alias("kind"), F.min_by("source", "article_id").alias("answered_kind"))
    competitor = F.col("company_id") % 10 != 0
    main = (F.floor(F.col("company_id") / 10) * 10).cast("long")
    skip = (F.col("answered") >= F.col("revision")) & (F.col("kind") == F.col("answered_kind"))
    return rows.where("p >= 0.5").select("company_id", "story", F.when(competitor, main).otherwise(F.col("company_id")).alias("target"), F.when(competitor, "competitor_impact").otherwise("main_response").alias("mode"), skip.alias("skip"))


def tiers(spark, sf_dir):
    """Tier of an article: probability band (the middle one if unknown) and sensitivity of its
    kind, one more if the press has it."""
    p = F.when(F.col("article_id") % 9 != 0, F.col("negative"))
    band = F.when(p.isNull(), "mid").when(p >= 0.85, "high").when(p >= 0.65, "mid").otherwise("low")
    level = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("story") % 3 + 1).cast("int"))
    lookup = F.create_map(*[F.lit(x) for (b, s), t in TIER.items() for x in (f"{b}/{s}", t)])
    tier = F.least(F.element_at(lookup, F.concat_ws("/", band, level)) + (F.col("source") == "error").cast("int"), F.lit(3))
    return articles(spark, sf_dir).groupBy("company_id", tier.alias("tier")).agg(F.count(F.lit(1)).alias("articles"))


QUERIES = {f.__name__: f for f in (type_hits, ambiguous_types, article_assessments, event_types, regulations, report_violations, leak_marks, case_retrieval, same_event, routed_events, tiers)}

_HITS = ", ".join("count(*) FILTER (WHERE " + " OR ".join(T.holds_term_sql("norm", w) for w in words) + f") AS {k}" for k, words in TYPES.items())
_STEMMED = f"list_distinct(list_filter(list_transform({T.tokens_sql(T.normalized_sql('text'))}, lambda w: regexp_replace(w, '(?:ing|ed|s)$', '')), lambda w: length(w) >= 3))"
_K = "CASE WHEN (article_id * 37) % 1000 / 1000 >= 0.5::DOUBLE OR negative >= 0.55::DOUBLE THEN (article_id * 61) % 1000 / 1000 * greatest((article_id * 37) % 1000 / 1000, 0.6::DOUBLE) ELSE (article_id * 37) % 1000 / 1000 * 0.3::DOUBLE END"
ORACLE_SQL = {
    "type_hits": f"""WITH n AS (SELECT source, {T.normalized_sql('text')} AS norm FROM documents), h AS (SELECT source, {_HITS} FROM n GROUP BY source), u AS (UNPIVOT h ON {', '.join(TYPES)} INTO NAME kind VALUE hits), r AS (SELECT *, row_number() OVER w AS place, lead(hits) OVER w AS second_hits FROM u WINDOW w AS (PARTITION BY source ORDER BY hits DESC, kind))
      SELECT source, kind, hits, second_hits, CASE WHEN hits >= {LEAST_HITS} AND hits >= second_hits * {TIMES_AHEAD} AND kind <> '{NEVER_BY_WORDS}' THEN 'keyword' ELSE 'fallback' END AS route FROM r WHERE place = 1""",
    "ambiguous_types": f"""WITH {ARTICLES_SQL}, u AS (SELECT article_id, negative, unnest([{{'i': 0, 'n': 'legal', 's': (article_id * 37) % 1000}}, {{'i': 1, 'n': 'safety', 's': (article_id * 61) % 1000}}, {{'i': 2, 'n': 'finance', 's': CAST(floor(negative * 1000) AS BIGINT)}}], recursive := true) FROM articles), r AS (SELECT *, row_number() OVER w AS place, lead(n) OVER w AS n2, lead(s) OVER w AS s2 FROM u WINDOW w AS (PARTITION BY article_id ORDER BY s DESC, i))
      SELECT article_id, n AS parent, CASE WHEN s - s2 < 150 THEN n2 END AS other, round(least(s / 1000, 0.5::DOUBLE + negative / 2), 6) AS confidence, least(s / 1000, 0.5::DOUBLE + negative / 2) < 0.5::DOUBLE AS needs_review FROM r WHERE place = 1""",
    "article_assessments": f"""WITH {ARTICLES_SQL}, k AS (SELECT *, {_K} AS kind FROM articles), p AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, kind * 0.20::DOUBLE + negative * 0.70::DOUBLE + (article_id % 10) / 10 * 0.10::DOUBLE)) AS p FROM k)
      SELECT article_id, round(kind, 6) AS kind_score, round(p, 6) AS probability, CASE WHEN kind < 0.20::DOUBLE OR p < 0.30::DOUBLE THEN 'non_risk' WHEN p >= 0.60::DOUBLE AND kind >= 0.35::DOUBLE THEN 'risk' ELSE 'uncertain' END AS decision FROM p""",
    "event_types": f"""WITH {ARTICLES_SQL}, m AS (SELECT company_id, story, max((article_id * 37) % 1000) AS l, max((article_id * 61) % 1000) AS s, max(CAST(floor(negative * 1000) AS BIGINT)) AS f, list_sort(list(seen_at) FILTER (WHERE negative >= 0.5::DOUBLE))[2] AS qualified_at FROM articles GROUP BY ALL)
      SELECT company_id, story, 'legal=' || l || ',safety=' || s || ',finance=' || f AS scores, CASE WHEN l >= s AND l >= f THEN 'legal' WHEN s >= f THEN 'safety' ELSE 'finance' END AS primary_type, qualified_at FROM m""",
    "regulations": """WITH r AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS kind, DATE '2023-01-01' + CAST(p_partkey % 500 AS INT) > DATE '2024-01-31' AS upcoming, p_size FROM part WHERE p_size > 5) SELECT p_partkey, kind, upcoming, CASE WHEN NOT upcoming AND p_size % 3 <> 0 THEN p_size END AS deadline_hours FROM r""",
    "report_violations": f"""WITH l AS (SELECT l_orderkey, bool_or(l_partkey % 97 = 0) AS unknown, count(*) FILTER (WHERE l_returnflag = 'R') AS strategies, list(DISTINCT l_suppkey % 7) FILTER (WHERE l_returnflag = 'A') AS a, list(DISTINCT l_suppkey % 7) FILTER (WHERE l_returnflag = 'N') AS n, max(l_quantity) AS hours, bool_or(l_linestatus = 'F') AS denies FROM lineitem GROUP BY 1), r AS (SELECT * FROM orders JOIN l ON o_orderkey = l_orderkey)
      SELECT o_orderkey, 'cites_unknown' AS rule FROM r WHERE unknown UNION ALL SELECT o_orderkey, 'denies_preventable' FROM r WHERE starts_with(o_orderpriority, '1') AND denies UNION ALL SELECT o_orderkey, 'too_many_strategies' FROM r WHERE strategies > {MOST_STRATEGIES} UNION ALL SELECT o_orderkey, 'too_many_risks' FROM r WHERE len(a) > {MOST_RISKS}
      UNION ALL SELECT o_orderkey, 'risk_on_both_sides' FROM r WHERE len(list_intersect(a, n)) > 0 UNION ALL SELECT o_orderkey, 'deadline_out_of_range' FROM r WHERE hours NOT BETWEEN 1 AND {MOST_HOURS / 2}""",
    "leak_marks": r"""WITH c AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[a-z]+_[a-z_]+')) AS BIGINT) AS snake, CAST(len(regexp_extract_all(coalesce(text, ''), 'https?://[^ \t\n\r]+|[a-z0-9.]+@[a-z0-9.-]+')) AS BIGINT) AS urls, regexp_matches(split_part(coalesce(text, ''), chr(10), 1), '[가-힣]') AS hangul FROM documents) SELECT * FROM c WHERE snake + urls > 0""",
    "case_retrieval": """WITH a AS (SELECT label, min(vec_id) AS ask FROM embeddings GROUP BY 1), r AS (SELECT label, vec_id AS case_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 7 = 0 DESC, vec_id) AS rank FROM embeddings JOIN a USING (label) WHERE vec_id <> ask AND vec_id % 11 <> ask % 11) SELECT label, rank, case_id, case_id % 7 = 0 AS curated FROM r WHERE rank <= 5""",
    "same_event": f"""WITH w AS (SELECT item_id, {_STEMMED} AS w FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS n_both, least(len(a.w), len(b.w)) AS n_least FROM w a JOIN w b ON a.item_id < b.item_id) SELECT a, b, round(n_both / n_least, 6) AS overlap FROM p WHERE n_both >= 3 AND n_both / n_least >= 0.2::DOUBLE""",
    "routed_events": f"""WITH {ARTICLES_SQL}, e AS (SELECT company_id, story, max(negative) AS p, max(article_id) AS revision, min(article_id) AS answered, arg_max(source, article_id) AS kind, arg_min(source, article_id) AS answered_kind FROM articles GROUP BY ALL) SELECT company_id, story, CASE WHEN company_id % 10 <> 0 THEN company_id // 10 * 10 ELSE company_id END AS target, CASE WHEN company_id % 10 <> 0 THEN 'competitor_impact' ELSE 'main_response' END AS mode, answered >= revision AND kind = answered_kind AS skip FROM e WHERE p >= 0.5::DOUBLE""",
    "tiers": f"""WITH {ARTICLES_SQL}, t AS (SELECT company_id, source, CASE WHEN article_id % 9 = 0 THEN 'mid' WHEN negative >= 0.85::DOUBLE THEN 'high' WHEN negative >= 0.65::DOUBLE THEN 'mid' ELSE 'low' END AS band, story % 3 AS sensitivity FROM articles), m AS (SELECT company_id, CAST(least(CASE WHEN band = 'high' THEN [3, 3, 2][sensitivity + 1] WHEN band = 'mid' THEN [3, 2, 2][sensitivity + 1] ELSE [2, 1, 1][sensitivity + 1] END + (source = 'error')::INT, 3) AS INT) AS tier FROM t) SELECT company_id, tier, count(*) AS articles FROM m GROUP BY ALL""",
}
