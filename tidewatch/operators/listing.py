"""Lists as a reader asks for them: search, filters, order, pages, priorities, shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.filtering import ITEMS_SQL, filter_stages, items
from tidewatch.operators.filtering import ORACLE_SQL as FILTER_SQL
from tidewatch.sources.scratch import written
from tidewatch.sources.tables import ARTICLES_SQL, articles, table

# Labels of two languages and what they mean (fixed values).
LABELS = {"positive": "positive", "긍정": "positive", "neutral": "neutral", "중립": "neutral", "negative": "negative", "부정": "negative"}
# Words that hint at a negative example (fixed values), and such of the documents' languages.
HINTS = ["사고", "유출", "논란", "소송", "리콜", "파업", "적자", "중단", "attion", "erble"]
PAGE, ROWS = 2, 25


def search(rows: DataFrame, text: str | None = None, source: str | None = None, language: str | None = None, since: str | None = None) -> DataFrame:
    """Items for which all conditions hold that are asked for; text is looked for in
    title and summary without regard to case."""
    wanted: list[Column] = []
    if text is not None:
        wanted.append(F.col("title").ilike(f"%{text}%") | F.col("summary").ilike(f"%{text}%"))
    if source is not None:
        wanted.append(F.col("source") == source)
    if language is not None:
        wanted.append(F.col("lang") == language)
    if since is not None:
        wanted.append(F.coalesce("published_at", "collected_at") >= F.lit(since).cast("timestamp_ntz"))
    return reduce(lambda a, c: a.where(c), wanted, rows)


def paged_search(spark, sf_dir):
    """Page two of English items with a word, newest publication first, undated last,
    and the number of all that were found."""
    found = search(items(spark, sf_dir), text="THAN", language="en", since="2024-01-01 02:00:00")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    page = found.orderBy(F.col("published_at").desc_nulls_last(), F.desc("raw_id")).offset((PAGE - 1) * ROWS).limit(ROWS)
    return page.select("raw_id", "source", "published_at").crossJoin(F.broadcast(total))  # one row


def any_of_three(spark, sf_dir):
    """Items that share URL path, title or hour and source with an item whose id is divisible
    by 50: three equal joins in place of one condition with OR.

    A pair is told by the first of the joins that makes it, so pairs, of which there are many,
    are not compared with each other; only those of an id that items share are."""
    light = items(spark, sf_dir).select("raw_id", F.regexp_extract("url", "(/[ab]/[0-9]+)", 1).alias("path"), F.md5("title").alias("title"), "source", F.date_trunc("hour", F.col("collected_at")).cast("timestamp_ntz").alias("hour"))
    repeated = light.groupBy("raw_id").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    rows = written(light.join(repeated, "raw_id"))
    few = rows.where("raw_id % 50 = 0").select(*[F.col(c).alias(f"_{c}") for c in rows.columns])
    ways = (F.col("path") == F.col("_path"), F.col("title") == F.col("_title"), (F.col("source") == F.col("_source")) & (F.col("hour") == F.col("_hour")))

    def met(k):
        new = [~F.coalesce(way, F.lit(False)) for way in ways[:k]]
        return rows.join(few, reduce(lambda a, b: a & b, new, ways[k] & (F.col("raw_id") != F.col("_raw_id"))))

    found = reduce(DataFrame.unionByName, [met(k).select("raw_id", F.col("_raw_id").alias("like_id"), (F.col("repeated") | F.col("_repeated")).alias("again")) for k in range(3)])
    return found.where("NOT again").drop("again").unionByName(found.where("again").drop("again").distinct())


def closed_neighbours(spark, sf_dir):
    """How many other articles of its company are within 15 minutes of one, both ends
    included. A window stands for a company and a day; near midnight rows stand twice."""
    seconds = F.unix_seconds(F.col("seen_at").cast("timestamp"))
    day = lambda t: F.floor(t / 86_400)
    rows = articles(spark, sf_dir).select("article_id", "company_id", seconds.alias("at"))
    spread = rows.withColumn("day", F.explode(F.array_distinct(F.array(day(F.col("at")), day(F.col("at") - 900), day(F.col("at") + 900)))))
    around = Window.partitionBy("company_id", "day").orderBy("at").rangeBetween(-900, 900)
    return spread.withColumn("near", F.count(F.lit(1)).over(around) - 1).where(F.col("day") == day(F.col("at"))).select("article_id", "near")


def event_list(spark, sf_dir):
    """Stories as events: critical ones first, then by probability, those without last;
    numbered in that order within a company."""
    rows = articles(spark, sf_dir).groupBy("company_id", "story").agg(F.max(F.when(F.col("source") != "signup", F.col("negative"))).alias("probability"), F.max("seen_at").alias("last_at"))
    rows = rows.withColumn("severity", F.when(F.col("probability") >= 0.85, "critical").otherwise("warning"))
    order = Window.partitionBy("company_id").orderBy((F.col("severity") == "critical").desc(), F.col("probability").desc_nulls_last(), F.desc("last_at"), F.desc("story"))
    return rows.select("company_id", "story", "severity", F.round("probability", 6).alias("probability"), F.row_number().over(order).cast("long").alias("place"))


def review_queue(spark, sf_dir):
    """Items that are not decided yet or not surely, by priority: uncertainty, half the
    advertising score, and a hint of a negative example."""
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    hint = F.exists(F.array(*map(F.lit, HINTS)), lambda w: F.contains(text, w))
    rows = filter_stages(spark, sf_dir).join(items(spark, sf_dir).select("raw_id", hint.alias("hint")), "raw_id")
    priority = F.round(1.0 - F.col("confidence") + F.col("ad_score") * 0.5 + F.when(F.col("hint"), 0.35).otherwise(0.0), 6)
    order = [F.desc("priority"), "raw_id"]
    return rows.select("raw_id", priority.alias("priority")).orderBy(*order).limit(50)


def label_values(spark, sf_dir):
    """A bilingual label's meaning, and the probability that stands for it: the model's
    if there is one, else 1 or 0 by the label, else none. Counted by both."""
    i = F.col("article_id")
    raw = F.when(i % 6 == 0, "긍정").when(i % 6 == 1, "부정").when(i % 6 == 2, "NEUTRAL").when(i % 6 == 3, F.initcap("label")).when(i % 6 == 4, "other")
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    label = F.try_element_at(known, F.lower(F.col("raw")))
    probability = F.when(i % 5 != 0, F.col("negative")).when(F.col("meaning") == "negative", 1.0).when(F.col("meaning").isNotNull(), 0.0)
    rows = articles(spark, sf_dir).withColumn("raw", raw).withColumn("meaning", label).withColumn("p", probability)
    return rows.groupBy("meaning").agg(F.count(F.lit(1)).alias("n"), F.count("p").alias("with_probability"), F.round(F.avg("p"), 6).alias("mean_probability"))


def ticker_clashes(spark, sf_dir):
    """Names that are equal without regard to case, as codes must be unique."""
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.initcap("c_mktsegment")), (F.col("c_custkey") % 40).cast("string"))
    rows = table(spark, sf_dir, "customer").groupBy(F.upper(name).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(name).alias("spellings"), F.min("c_custkey").alias("first"))
    return rows.where("n > 1")


def company_names(spark, sf_dir):
    """Names without case, blanks and signs between, and how many share one."""
    clean = F.regexp_replace(F.lower("c_name"), "[ ·._#-]+", "")
    return table(spark, sf_dir, "customer").groupBy(F.regexp_replace(clean, "[0-9]+$", "").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length(clean)).cast("long").alias("longest"))


def key_prefixes(spark, sf_dir):
    """Parts whose type begins with a word, by that prefix, and those with another inside."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").startswith("PROMO").alias("promo"), F.contains("p_type", F.lit("BRASS")).alias("brass"), "p_retailprice")
    return rows.groupBy("promo", "brass").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


def top_hosts_share(spark, sf_dir):
    """Per company its five most frequent sources' shares of all its articles, rounded to
    four digits, as one map in JSON, ties by name."""
    by = articles(spark, sf_dir).groupBy("company_id", F.concat("source", F.lit("-"), (F.col("story") % 3).cast("string")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("company_id")
    ranked = by.withColumns({"place": F.row_number().over(order.orderBy(F.desc("n"), "host")), "total": F.sum("n").over(order)}).where("place <= 5")
    share = F.concat("host", F.lit("="), F.format_number(F.col("n") / F.col("total"), 4))
    return ranked.groupBy("company_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", share.alias("s")))), lambda x: x["s"]), ",").alias("mix"))


def json_merge(spark, sf_dir):
    """Stored properties with later ones put over them: equal keys take the later value;
    values that are no number count as none. Told as text in order of keys."""
    stored, later = F.from_json("props", "map<string,string>"), F.create_map(F.lit("k"), F.when(F.col("event_id") % 2 == 0, F.lit("x7")).otherwise((F.col("event_id") % 9).cast("string")), F.lit("v"), F.col("event_type"))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(later), k)), later)
    told = F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ";")
    number = F.try_to_number(F.element_at(merged, "k"), F.lit("999")).cast("long")
    return table(spark, sf_dir, "events").select("event_id", told.alias("merged"), number.alias("k"))


def thread_comments(spark, sf_dir):
    """Threads with their comments as nested rows, flattened again: the first comment and
    twenty answers of it, none of threads that are closed to comments."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("comments"))
    flat = turns.where("conv_id % 7 <> 0").select("conv_id", F.posexplode(F.slice("comments", 1, 21)).alias("at", "c"))
    return flat.select("conv_id", F.col("at").cast("long").alias("place"), "c.turn", F.coalesce("c.role", F.lit("user")).alias("author"), F.char_length("c.text").cast("long").alias("n_chars"))


def alias_keys(spark, sf_dir):
    """The value of the first key of several that a row has, and its canonical name."""
    raw = F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("body"), F.col("role").alias("channel")))).when(F.col("conv_id") % 3 == 1, F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("source")))).otherwise(F.to_json(F.struct(F.col("text").alias("text"))))
    pick = lambda *keys: F.coalesce(*[F.get_json_object("raw", f"$.{k}") for k in keys])
    canonical = F.create_map(*[F.lit(x) for x in ("assistant", "model", "user", "reader", "human", "reader")])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return rows.select("conv_id", "turn", F.md5(pick("text", "content", "body")).alias("digest"), F.coalesce(F.try_element_at(canonical, pick("source", "channel")), F.lit("none")).alias("channel"))


QUERIES = {f.__name__: f for f in (paged_search, any_of_three, closed_neighbours, event_list, review_queue, label_values, ticker_clashes, company_names, key_prefixes, top_hosts_share, json_merge, thread_comments, alias_keys)}

ORACLE_SQL = {
    "paged_search": f"""WITH {ITEMS_SQL}, f AS (SELECT * FROM items WHERE (title ILIKE '%THAN%' OR summary ILIKE '%THAN%') AND lang = 'en' AND coalesce(published_at, collected_at) >= TIMESTAMP '2024-01-01 02:00:00')
      SELECT raw_id, source, published_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY published_at DESC NULLS LAST, raw_id DESC LIMIT {ROWS} OFFSET {(PAGE - 1) * ROWS}""",
    "any_of_three": f"""WITH {ITEMS_SQL}, r AS (SELECT *, regexp_extract(url, '(/[ab]/[0-9]+)', 1) AS path, date_trunc('hour', collected_at) AS h FROM items)
      SELECT a.raw_id, b.raw_id AS like_id FROM r a JOIN r b ON b.raw_id % 50 = 0 AND a.raw_id <> b.raw_id AND (a.path = b.path OR a.title = b.title OR (a.source = b.source AND a.h = b.h))""",
    "closed_neighbours": f"WITH {ARTICLES_SQL}, e AS (SELECT article_id, company_id, CAST(floor(epoch(seen_at)) AS BIGINT) AS sec FROM articles) SELECT article_id, count(*) OVER (PARTITION BY company_id ORDER BY sec RANGE BETWEEN 900 PRECEDING AND 900 FOLLOWING) - 1 AS near FROM e",
    "event_list": f"""WITH {ARTICLES_SQL}, s AS (SELECT company_id, story, max(negative) FILTER (WHERE source <> 'signup') AS p, max(seen_at) AS last_at FROM articles GROUP BY ALL), v AS (SELECT *, CASE WHEN p >= 0.85::DOUBLE THEN 'critical' ELSE 'warning' END AS severity FROM s)
      SELECT company_id, story, severity, round(p, 6) AS probability, row_number() OVER (PARTITION BY company_id ORDER BY severity = 'critical' DESC, p DESC NULLS LAST, last_at DESC, story DESC) AS place FROM v""",
    "review_queue": f"""WITH st AS ({FILTER_SQL['filter_stages']}), {ITEMS_SQL} SELECT raw_id, round(1.0::DOUBLE - confidence + ad_score * 0.5::DOUBLE + CASE WHEN {' OR '.join(f"contains(lower(concat_ws(' ', title, summary)), '{w}')" for w in HINTS)} THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END, 6) AS priority
      FROM st JOIN items USING (raw_id) ORDER BY priority DESC, raw_id LIMIT 50""",
    "label_values": f"""WITH {ARTICLES_SQL}, r AS (SELECT *, CASE article_id % 6 WHEN 0 THEN '긍정' WHEN 1 THEN '부정' WHEN 2 THEN 'NEUTRAL' WHEN 3 THEN upper(label[1]) || label[2:] WHEN 4 THEN 'other' END AS raw FROM articles), m AS (SELECT *, CASE WHEN lower(raw) IN ('positive', '긍정') THEN 'positive' WHEN lower(raw) IN ('neutral', '중립') THEN 'neutral' WHEN lower(raw) IN ('negative', '부정') THEN 'negative' END AS meaning FROM r),
      p AS (SELECT meaning, CASE WHEN article_id % 5 <> 0 THEN negative WHEN meaning = 'negative' THEN 1.0 WHEN meaning IS NOT NULL THEN 0.0 END AS p FROM m) SELECT meaning, count(*) AS n, count(p) AS with_probability, round(avg(p), 6) AS mean_probability FROM p GROUP BY meaning""",
    "ticker_clashes": """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END || (c_custkey % 40) AS name FROM customer) SELECT upper(name) AS code, count(*) AS n, count(DISTINCT name) AS spellings, min(c_custkey) AS first FROM n GROUP BY 1 HAVING count(*) > 1""",
    "company_names": """WITH n AS (SELECT regexp_replace(lower(c_name), '[ ·._#-]+', '', 'g') AS clean FROM customer) SELECT regexp_replace(clean, '[0-9]+$', '') AS name, count(*) AS n, CAST(max(length(clean)) AS BIGINT) AS longest FROM n GROUP BY 1""",
    "key_prefixes": "SELECT starts_with(p_type, 'PROMO') AS promo, contains(p_type, 'BRASS') AS brass, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY ALL",
    "top_hosts_share": f"""WITH {ARTICLES_SQL}, b AS (SELECT company_id, source || '-' || (story % 3) AS host, count(*) AS n FROM articles GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, host) AS place, sum(n) OVER (PARTITION BY company_id) AS total FROM b)
      SELECT company_id, string_agg(host || '=' || format('{{:.4f}}', round(n / total, 4)), ',' ORDER BY place) AS mix FROM r WHERE place <= 5 GROUP BY company_id""",
    "json_merge": """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'x7' ELSE CAST(event_id % 9 AS VARCHAR) END AS k FROM events) SELECT event_id, 'k:' || k || ';v:' || event_type AS merged, TRY_CAST(k AS BIGINT) AS k FROM e""",
    "thread_comments": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place FROM conversations) SELECT conv_id, place, turn, coalesce(role, 'user') AS author, CAST(length(text) AS BIGINT) AS n_chars FROM c WHERE place < 21 AND conv_id % 7 <> 0""",
    "alias_keys": """SELECT conv_id, turn, md5(text) AS digest, CASE WHEN conv_id % 3 = 2 THEN 'none' ELSE CASE role WHEN 'assistant' THEN 'model' WHEN 'user' THEN 'reader' WHEN 'human' THEN 'reader' ELSE 'none' END END AS channel FROM conversations""",
}
