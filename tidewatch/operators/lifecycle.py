"""Decisions and lifecycles: data quality, incidents, duplicates, bands, synchronisation,
snapshots, tiers, splits, cohorts, notifications."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import series
from tidewatch.operators.filtering import first_near, seconds
from tidewatch.sources.tables import ARTICLES_SQL, ATTEMPTS_SQL, articles, attempts, table

# Secrets in messages (fixed values).
SECRETS = ["(?i)(api[_-]?key|token|secret)([ \\t]*[:=][ \\t]*)[^ \\t\\r\\n,&]+", "(?i)(client[_-]?secret)([ \\t]*[:=][ \\t]*)[^ \\t\\r\\n,&]+", "(?i)(authorization)([ \\t]*[:=][ \\t]*)(?:bearer[ \\t]+|basic[ \\t]+)?[^ \\t\\r\\n,;&]+"]
# What tells that a database speaks, and that it is a conflict (fixed values).
DATABASE_MARKS = ["sqlalchemy.exc", "psycopg.errors", "integrityerror", "uniqueviolation", "duplicate key value", "violates unique constraint", "database integrity conflict", "database operation failed", "[sql:", "[parameters:"]
CONFLICT_MARKS = ["duplicate key", "uniqueviolation", "database integrity conflict"]
CUT_FROM = "(?is)[ ]+(?:\\[sql:|\\[parameters:|\\(background on this error).*$"


def data_quality_state(spark, sf_dir):
    """A slot is complete, partial or unavailable by the sources that succeeded in it."""
    by_source = attempts(spark, sf_dir).groupBy("company_id", "slot", "source").agg(F.bool_or("succeeded").alias("ok"))
    rows = by_source.groupBy("company_id", "slot").agg(F.count_if("ok").alias("ok_sources"), F.count_if(~F.col("ok")).alias("failed_sources"))
    state = F.when(F.col("ok_sources") == 0, "unavailable").when(F.col("failed_sources") > 0, "partial").otherwise("complete")
    return rows.withColumn("quality", state)


def source_health(spark, sf_dir):
    """A source is healthy if no company's latest attempt failed, partial if some
    company's succeeded or no streak is longer than one slot, else down."""
    rows = series.source_streak(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("streak") > 0).alias("failing"), F.count_if(F.col("streak") == 0).alias("fine"), F.max("streak").alias("longest"))
    status = F.when(F.col("failing") == 0, "healthy").when((F.col("fine") > 0) | (F.col("longest") == 1), "partial").otherwise("down")
    return rows.withColumn("status", status)


def collection_incidents(spark, sf_dir):
    """Runs of failed attempts of a source: opened, last failure, and recovery by the
    next success. Successes so far number the runs, as each success ends one."""
    order = Window.partitionBy("company_id", "source").orderBy("slot", "attempt_id")
    rows = attempts(spark, sf_dir).withColumn("run", F.sum(F.col("succeeded").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    failed = F.when(~F.col("succeeded"), F.col("slot"))
    runs = rows.groupBy("company_id", "source", "run").agg(F.min("slot").alias("began"), F.min(failed).alias("opened_at"), F.max(failed).alias("last_failed_at"), F.count(failed).alias("failures"))
    runs = runs.withColumn("recovered_at", F.lead("began").over(Window.partitionBy("company_id", "source").orderBy("run"))).where("failures > 0")
    return runs.select(F.md5(F.concat_ws("|", "company_id", "source", "run")).alias("fingerprint"), "company_id", "source", "opened_at", "last_failed_at", "failures", "recovered_at")


def duplicate_rule(spark, sf_dir):
    """An article repeats another of its story (which stands for its title) within fifteen
    minutes to either side; the smallest id counts. Sign-ups, which stand for comments,
    neither are duplicates nor have any."""
    rows = articles(spark, sf_dir)
    speaking = rows.where("source <> 'signup'").select(F.col("article_id").alias("raw_id"), F.concat_ws("/", "company_id", "story").alias("title"), seconds("published_at").alias("published"), seconds("created_at").alias("collected"))
    found = first_near(speaking).withColumnRenamed("raw_id", "article_id")
    return rows.select("article_id").join(found, "article_id", "left").select("article_id", F.col("of_title").alias("duplicate_of"))


def band_decision(spark, sf_dir):
    """Advertising bands, then relevance bands, decide; the rest goes to review."""
    relevance, advertising = F.col("l_discount") * 10, F.col("l_tax") * 12
    reason = F.when(advertising >= 0.85, "advertisement").when(advertising >= 0.55, "possible_advertisement").when(relevance >= 0.7, "relevant").when(relevance <= 0.3, "unrelated").otherwise("uncertain")
    decision = F.when(F.col("reason").isin("advertisement", "unrelated"), "rejected").when(F.col("reason") == "relevant", "accepted").otherwise("review")
    rows = table(spark, sf_dir, "lineitem").select(reason.alias("reason"), (0.5 + F.abs(relevance - 0.5)).alias("confidence"))
    return rows.groupBy("reason", decision.alias("decision")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def set_diff_sync(spark, sf_dir):
    """What to do so that the stored story events become the wanted ones: open,
    withdraw, revise (the score moved by 0.05 or more) or keep."""
    rows = articles(spark, sf_dir).groupBy("company_id", "story", (F.col("seen_at") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("early")).agg(F.round(F.max("negative"), 6).alias("score"))
    stored = rows.where("early").select("company_id", "story", F.col("score").alias("stored"))
    wanted = rows.where("not early").select("company_id", "story", F.col("score").alias("wanted"))
    action = F.when(F.col("stored").isNull(), "open").when(F.col("wanted").isNull(), "withdraw").when(F.abs(F.col("wanted") - F.col("stored")) >= 0.05, "revise").otherwise("keep")
    return stored.join(wanted, ["company_id", "story"], "full").withColumn("action", action)


def snapshot_first8(spark, sf_dir):
    """A story as it was after a day: at most its first eight articles."""
    of = Window.partitionBy("company_id", "story")
    rows = articles(spark, sf_dir).withColumns({"first_at": F.min("created_at").over(of), "n": F.row_number().over(of.orderBy("created_at", "article_id"))})
    rows = rows.where((F.col("created_at") < F.col("first_at") + F.expr("INTERVAL 24 HOURS")) & (F.col("n") <= 8))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "article_id"))), lambda s: s["article_id"].cast("string")), ",")
    return rows.groupBy("company_id", "story").agg(ids.alias("article_ids"), F.count(F.lit(1)).alias("articles"), F.countDistinct("source").alias("sources"), F.round(F.avg("negative"), 6).alias("mean_negative"), F.round(F.max("negative"), 6).alias("max_negative"))


def tier_lookup(spark, sf_dir):
    """Articles by response tier: probability band and sensitivity, one more for errors."""
    band = F.when(F.col("negative") >= 0.85, 3).when(F.col("negative") >= 0.65, 2).otherwise(1)
    tier = F.least(band + (F.col("story") % 3).cast("int") + (F.col("source") == "error").cast("int"), F.lit(5))
    return articles(spark, sf_dir).groupBy("company_id", tier.alias("tier")).agg(F.count(F.lit(1)).alias("articles"))


def group_split(spark, sf_dir):
    """Stories of a company in order of their first article: 70 % train, 15 % validation,
    15 % test; a story is never split."""
    rows = articles(spark, sf_dir).groupBy("company_id", "story").agg(F.min("seen_at").alias("first_at"))
    of = Window.partitionBy("company_id")
    share = F.row_number().over(of.orderBy("first_at", "story")) / F.count(F.lit(1)).over(of)
    return rows.select("company_id", "story", F.when(share <= 0.7, "train").when(share <= 0.85, "validation").otherwise("test").alias("split"))


def _holds(text, words):
    """Whether a text holds any of the words."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def with_summary(rows, message="message"):
    """rows with `summary`, an operator's summary of an error: secrets and authorisation
    masked, what a database says told in two words only, what follows a statement cut off,
    800 characters at most. Each step is a column of its own, so a text is masked once."""
    text = F.trim(F.replace(F.coalesce(F.nullif(message, F.lit("")), F.lit("unknown collection error")), F.lit("\n"), F.lit(" ")))
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "$1$2[REDACTED]")
    rows = rows.withColumn("__text", text).withColumn("__low", F.lower("__text"))
    text, low = F.col("__text"), F.col("__low")
    lead = F.when(low.startswith("pipeline:"), "pipeline: ").otherwise("")
    cut = F.regexp_replace(text, CUT_FROM, "")
    summary = F.when(_holds(low, CONFLICT_MARKS), F.concat(lead, F.lit("데이터 저장 충돌"))).when(_holds(low, DATABASE_MARKS), F.concat(lead, F.lit("데이터베이스 작업 실패"))).otherwise(F.substr(cut, F.lit(1), F.lit(800)))
    return rows.withColumn("summary", summary).drop("__text", "__low")


def with_code(rows, message):
    """rows with `code`, a stable part of a fingerprint: what kind of error a message tells."""
    rows = rows.withColumn("__low", F.lower(F.coalesce(message, F.lit(""))))
    has = lambda *words: _holds(F.col("__low"), words)
    code = F.when(has("timeout", "timed out"), "timeout").when(has("401", "403", "unauthorized"), "authentication").when(has("429", "rate"), "rate_limit").when(has("connection", "network"), "network")
    return rows.withColumn("code", code.when(has("key") & has("설정"), "configuration").when(has("database integrity conflict", "데이터 저장 충돌"), "database_conflict").otherwise("provider_error")).drop("__low")


def error_messages(spark, sf_dir):
    """Failed attempts with an error message, made of their numbers."""
    i = F.col("attempt_id")
    kinds = ["Timeout after 30s for api_key=abc%d, retry", "HTTP 401 Unauthorized: authorization: Bearer tok%d;x", "HTTP 429 rate limit", "connection reset by peer", "pipeline: IntegrityError duplicate key value %d", "psycopg.errors.Deadlock (x) [SQL: UPDATE t SET a=%d]", "provider said no (Background on this error at: http://x/%d)", "secret = s%d&b=1\nline two"]
    said = [F.format_string(k, i) if "%d" in k else F.lit(k) for k in kinds]
    message = F.when(i.isNull(), F.lit(None).cast("string"))
    for k, text in enumerate(said[:-1]):
        message = message.when(i % len(kinds) == k, text)
    return attempts(spark, sf_dir).where(~F.col("succeeded")).withColumn("message", message.otherwise(said[-1]))


def error_sanitize(spark, sf_dir):
    """Error messages as an operator may see them, and their codes."""
    return with_code(with_summary(error_messages(spark, sf_dir)), "message").select("attempt_id", "summary", "code")


def incident_slots(spark, sf_dir):
    """Incidents of a company's slot: quality, failed sources and codes make the
    fingerprint; retries are due 1, 5 and 15 minutes after the first three failures in a
    row of a fingerprint; a company has recovered when every failed source has succeeded
    later. Attempts are counted by slot, source and code before anything else, so what is
    joined and ordered grows with the slots, not with the attempts."""
    slot = ["company_id", "slot", "source"]
    codes = with_code(with_summary(error_messages(spark, sf_dir)), "summary").withColumn("code", F.when(F.col("attempt_id").isNotNull(), F.col("code")))
    failures = codes.groupBy(*slot, "code").agg(F.count(F.lit(1)).alias("bad"))
    fine = attempts(spark, sf_dir).where("succeeded")
    last_ok = fine.groupBy("company_id", "source").agg(F.max("slot").alias("last_ok"))
    rows = failures.unionByName(fine.groupBy(*slot).agg(F.count(F.lit(1)).alias("ok")), allowMissingColumns=True).join(last_ok, ["company_id", "source"], "left")
    failed = lambda c: F.array_sort(F.collect_set(F.when(F.col("bad") > 0, F.col(c))))
    by_slot = rows.groupBy("company_id", "slot").agg(F.sum("ok").alias("ok"), F.sum("bad").alias("bad"), failed("source").alias("sources"), failed("code").alias("codes"), F.min(F.when(F.col("bad") > 0, F.coalesce(F.col("last_ok") > F.col("slot"), F.lit(False)))).alias("recovered")).where("bad > 0")
    quality = F.when(F.col("ok") > 0, "partial").otherwise("unavailable")
    material = F.concat_ws("|", "quality", F.array_join("sources", "|"), F.array_join("codes", "|"))
    by_slot = by_slot.withColumn("quality", quality).withColumn("fingerprint", F.sha2(material, 256))
    tried = Window.partitionBy("company_id", "fingerprint").orderBy("slot")
    delay = F.element_at(F.array(*map(F.lit, (60, 300, 900))), F.least(F.col("attempt"), F.lit(3)).cast("int"))
    return by_slot.withColumn("attempt", F.row_number().over(tried)).select("company_id", "slot", "quality", "fingerprint", F.col("attempt").cast("long").alias("attempt"), F.when((F.col("attempt") <= 3) & ~F.col("recovered"), F.col("slot") + F.make_dt_interval(secs=delay)).alias("retry_at"), "recovered")


def period_cohort(spark, sf_dir):
    """Stories of two articles or more whose last one is in the period, by its day."""
    rows = articles(spark, sf_dir).groupBy("company_id", "story").agg(F.to_date(F.max("seen_at")).alias("day"), F.count(F.lit(1)).alias("n"), F.max("negative").alias("worst"))
    rows = rows.where((F.col("day") >= F.lit("2024-01-10").cast("date")) & (F.col("day") <= F.lit("2024-01-20").cast("date")) & (F.col("n") >= 2))
    return rows.groupBy("day", F.when(F.col("worst") >= 0.85, "risk").otherwise("non_risk").alias("state")).agg(F.count(F.lit(1)).alias("stories"), F.sum("n").alias("articles"))


def raw_merge(spark, sf_dir):
    """Documents of one source, language and text are one: the longest stays, then the
    first. Texts are told apart by a digest of the whole."""
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    kept = rows.agg(F.max_by("doc_id", F.struct(F.col("n_chars"), -F.col("doc_id"))).alias("doc_id"), F.count(F.lit(1)).alias("merged"), F.max("n_chars").alias("n_chars"))
    return kept.select("source", "lang", "doc_id", "merged", "n_chars")


def raw_merge_content(spark, sf_dir):
    """Documents of one source, language and whole text, white space aside: the longest
    stays, then the first."""
    content = F.sha2(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")), 256)
    rows = table(spark, sf_dir, "documents").groupBy("source", "lang", content.alias("content"))
    kept = rows.agg(F.max_by("doc_id", F.struct(F.col("n_chars"), -F.col("doc_id"))).alias("doc_id"), F.count(F.lit(1)).alias("merged"), F.max("n_chars").alias("n_chars"))
    return kept.select("source", "lang", "doc_id", "merged", "n_chars")


def notifications(spark, sf_dir):
    """One notification a story in the last three days: the worst article, then the newest."""
    rows = articles(spark, sf_dir).where((F.col("seen_at") >= F.lit("2024-01-28").cast("timestamp_ntz")) & (F.col("negative") >= 0.66))
    order = Window.partitionBy("company_id", "story").orderBy(F.desc("negative"), F.desc("article_id"))
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("company_id", "story", "article_id", "seen_at")


def authoritative_pick(spark, sf_dir):
    """The attempt that counts: a success before a failure, then the newest."""
    order = F.struct("succeeded", "slot", "attempt_id")
    return attempts(spark, sf_dir).groupBy("company_id", "source").agg(F.max(order).alias("pick")).select("company_id", "source", "pick.attempt_id", "pick.succeeded")


def agreement_rate(spark, sf_dir):
    """Agreement of a rule with the labels by language, and Cohen's kappa."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("y"), (~F.contains("text", F.lit("!!"))).alias("p"))
    by = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("p")).cast("double")).alias("po"), F.avg(F.col("y").cast("double")).alias("sy"), F.avg(F.col("p").cast("double")).alias("sp"))
    chance = F.col("sy") * F.col("sp") + (1 - F.col("sy")) * (1 - F.col("sp"))
    return by.select("lang", "n", F.round("po", 6).alias("agreement"), F.round(F.when(chance < 1, (F.col("po") - chance) / (1 - chance)), 6).alias("kappa"))


QUERIES = {f.__name__: f for f in (data_quality_state, source_health, collection_incidents, duplicate_rule, band_decision, set_diff_sync, snapshot_first8, tier_lookup, group_split, error_sanitize, period_cohort, raw_merge, raw_merge_content, incident_slots, notifications, authoritative_pick, agreement_rate)}

_MESSAGES_SQL = f"""{ATTEMPTS_SQL}, said AS (SELECT *, CASE attempt_id % 8 WHEN 0 THEN 'Timeout after 30s for api_key=abc' || attempt_id || ', retry' WHEN 1 THEN 'HTTP 401 Unauthorized: authorization: Bearer tok' || attempt_id || ';x' WHEN 2 THEN 'HTTP 429 rate limit' WHEN 3 THEN 'connection reset by peer'
    WHEN 4 THEN 'pipeline: IntegrityError duplicate key value ' || attempt_id WHEN 5 THEN 'psycopg.errors.Deadlock (x) [SQL: UPDATE t SET a=' || attempt_id || ']' WHEN 6 THEN 'provider said no (Background on this error at: http://x/' || attempt_id || ')' ELSE 'secret = s' || attempt_id || '&b=1' || chr(10) || 'line two' END AS message FROM attempts WHERE NOT succeeded),
  masked AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(replace(message, chr(10), ' ')), '{SECRETS[0]}', '\\1\\2[REDACTED]', 'g'), '{SECRETS[1]}', '\\1\\2[REDACTED]', 'g'), '{SECRETS[2]}', '\\1\\2[REDACTED]', 'g') AS plain FROM said),
  marked AS (SELECT *, lower(plain) AS low FROM masked)"""
_any_sql = lambda words: " OR ".join(f"contains(low, '{w}')" for w in words)
_SUMMARY_SQL = f"CASE WHEN {_any_sql(CONFLICT_MARKS)} THEN CASE WHEN starts_with(low, 'pipeline:') THEN 'pipeline: ' ELSE '' END || '데이터 저장 충돌' WHEN {_any_sql(DATABASE_MARKS)} THEN CASE WHEN starts_with(low, 'pipeline:') THEN 'pipeline: ' ELSE '' END || '데이터베이스 작업 실패' ELSE substr(regexp_replace(plain, '{CUT_FROM}', ''), 1, 800) END"


def _code_sql(message: str) -> str:
    has = lambda *words: "(" + " OR ".join(f"contains(lower({message}), '{w}')" for w in words) + ")"
    return f"CASE WHEN {has('timeout', 'timed out')} THEN 'timeout' WHEN {has('401', '403', 'unauthorized')} THEN 'authentication' WHEN {has('429', 'rate')} THEN 'rate_limit' WHEN {has('connection', 'network')} THEN 'network' WHEN {has('key')} AND {has('설정')} THEN 'configuration' WHEN {has('database integrity conflict', '데이터 저장 충돌')} THEN 'database_conflict' ELSE 'provider_error' END"


ORACLE_SQL = {
    "data_quality_state": f"""WITH {ATTEMPTS_SQL}, b AS (SELECT company_id, slot, source, bool_or(succeeded) AS ok FROM attempts GROUP BY ALL),
      c AS (SELECT company_id, slot, count(*) FILTER (WHERE ok) AS ok_sources, count(*) FILTER (WHERE NOT ok) AS failed_sources FROM b GROUP BY ALL)
      SELECT *, CASE WHEN ok_sources = 0 THEN 'unavailable' WHEN failed_sources > 0 THEN 'partial' ELSE 'complete' END AS quality FROM c""",
    "source_health": f"""WITH s AS (SELECT source, count(*) FILTER (WHERE streak > 0) AS failing, count(*) FILTER (WHERE streak = 0) AS fine, max(streak) AS longest FROM ({series.ORACLE_SQL['source_streak']}) GROUP BY source)
      SELECT *, CASE WHEN failing = 0 THEN 'healthy' WHEN fine > 0 OR longest = 1 THEN 'partial' ELSE 'down' END AS status FROM s""",
    "collection_incidents": f"""WITH {ATTEMPTS_SQL}, r AS (SELECT *, CAST(sum(succeeded::INT) OVER (PARTITION BY company_id, source ORDER BY slot, attempt_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM attempts),
      g AS (SELECT company_id, source, run, min(slot) AS began, min(slot) FILTER (WHERE NOT succeeded) AS opened_at, max(slot) FILTER (WHERE NOT succeeded) AS last_failed_at, count(*) FILTER (WHERE NOT succeeded) AS failures FROM r GROUP BY ALL),
      n AS (SELECT *, lead(began) OVER (PARTITION BY company_id, source ORDER BY run) AS recovered_at FROM g)
      SELECT md5(company_id || '|' || source || '|' || run) AS fingerprint, company_id, source, opened_at, last_failed_at, failures, recovered_at FROM n WHERE failures > 0""",
    "duplicate_rule": f"""WITH {ARTICLES_SQL}, s AS (SELECT * FROM articles WHERE source <> 'signup'), f AS (SELECT a.article_id, min(b.article_id) AS duplicate_of FROM s a JOIN s b ON a.company_id = b.company_id AND a.story = b.story AND b.article_id < a.article_id
        AND CASE WHEN a.published_at IS NOT NULL AND b.published_at IS NOT NULL THEN abs(floor(epoch(a.published_at)) - floor(epoch(b.published_at))) ELSE abs(floor(epoch(a.created_at)) - floor(epoch(b.created_at))) END <= 900 GROUP BY 1)
      SELECT article_id, duplicate_of FROM articles LEFT JOIN f USING (article_id)""",
    "band_decision": """WITH s AS (SELECT l_discount * 10 AS r, l_tax * 12 AS a FROM lineitem), t AS (SELECT r, CASE WHEN a >= 0.85::DOUBLE THEN 'advertisement' WHEN a >= 0.55::DOUBLE THEN 'possible_advertisement' WHEN r >= 0.7::DOUBLE THEN 'relevant' WHEN r <= 0.3::DOUBLE THEN 'unrelated' ELSE 'uncertain' END AS reason FROM s)
      SELECT reason, CASE WHEN reason IN ('advertisement', 'unrelated') THEN 'rejected' WHEN reason = 'relevant' THEN 'accepted' ELSE 'review' END AS decision, count(*) AS n, round(avg(0.5::DOUBLE + abs(r - 0.5::DOUBLE)), 6) AS confidence FROM t GROUP BY 1, 2""",
    "set_diff_sync": f"""WITH {ARTICLES_SQL}, s AS (SELECT company_id, story, round(max(negative), 6) AS stored FROM articles WHERE seen_at < TIMESTAMP '2024-01-16' GROUP BY ALL), w AS (SELECT company_id, story, round(max(negative), 6) AS wanted FROM articles WHERE seen_at >= TIMESTAMP '2024-01-16' GROUP BY ALL)
      SELECT company_id, story, stored, wanted, CASE WHEN stored IS NULL THEN 'open' WHEN wanted IS NULL THEN 'withdraw' WHEN abs(wanted - stored) >= 0.05::DOUBLE THEN 'revise' ELSE 'keep' END AS action FROM s FULL JOIN w USING (company_id, story)""",
    "snapshot_first8": f"""WITH {ARTICLES_SQL}, r AS (SELECT *, min(created_at) OVER (PARTITION BY company_id, story) AS first_at, row_number() OVER (PARTITION BY company_id, story ORDER BY created_at, article_id) AS n FROM articles)
      SELECT company_id, story, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY n) AS article_ids, count(*) AS articles, count(DISTINCT source) AS sources, round(avg(negative), 6) AS mean_negative, round(max(negative), 6) AS max_negative
      FROM r WHERE created_at < first_at + INTERVAL 24 HOURS AND n <= 8 GROUP BY ALL""",
    "tier_lookup": f"""WITH {ARTICLES_SQL}, t AS (SELECT company_id, CAST(least(CASE WHEN negative >= 0.85::DOUBLE THEN 3 WHEN negative >= 0.65::DOUBLE THEN 2 ELSE 1 END + story % 3 + (source = 'error')::INT, 5) AS INT) AS tier FROM articles)
      SELECT company_id, tier, count(*) AS articles FROM t GROUP BY ALL""",
    "group_split": f"""WITH {ARTICLES_SQL}, g AS (SELECT company_id, story, min(seen_at) AS first_at FROM articles GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY first_at, story) / count(*) OVER (PARTITION BY company_id) AS share FROM g)
      SELECT company_id, story, CASE WHEN share <= 0.7::DOUBLE THEN 'train' WHEN share <= 0.85::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM s""",
    "error_sanitize": f"""WITH {_MESSAGES_SQL} SELECT attempt_id, {_SUMMARY_SQL} AS summary, {_code_sql('message')} AS code FROM marked""",
    "incident_slots": f"""WITH {_MESSAGES_SQL}, c AS (SELECT attempt_id, {_code_sql(_SUMMARY_SQL)} AS code FROM marked), o AS (SELECT company_id, source, max(slot) AS last_ok FROM attempts WHERE succeeded GROUP BY ALL),
      b AS (SELECT company_id, slot, count(*) FILTER (WHERE succeeded) AS ok, list_sort(list(DISTINCT source) FILTER (WHERE NOT succeeded)) AS sources, list_sort(list(DISTINCT code) FILTER (WHERE NOT succeeded)) AS codes, bool_and(coalesce(last_ok > slot, FALSE)) FILTER (WHERE NOT succeeded) AS recovered
        FROM attempts LEFT JOIN c USING (attempt_id) LEFT JOIN o USING (company_id, source) GROUP BY ALL HAVING count(*) FILTER (WHERE NOT succeeded) > 0),
      q AS (SELECT *, CASE WHEN ok = 0 THEN 'unavailable' ELSE 'partial' END AS quality FROM b), f AS (SELECT *, sha256(quality || '|' || array_to_string(sources, '|') || '|' || array_to_string(codes, '|')) AS fingerprint FROM q), n AS (SELECT *, row_number() OVER (PARTITION BY company_id, fingerprint ORDER BY slot) AS attempt FROM f)
      SELECT company_id, slot, quality, fingerprint, attempt, CASE WHEN attempt <= 3 AND NOT recovered THEN slot + to_seconds(CASE attempt WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 900 END) END AS retry_at, recovered FROM n""",
    "period_cohort": f"""WITH {ARTICLES_SQL}, s AS (SELECT company_id, story, CAST(max(seen_at) AS DATE) AS day, count(*) AS n, max(negative) AS worst FROM articles GROUP BY company_id, story)
      SELECT day, CASE WHEN worst >= 0.85::DOUBLE THEN 'risk' ELSE 'non_risk' END AS state, count(*) AS stories, CAST(sum(n) AS BIGINT) AS articles FROM s WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND n >= 2 GROUP BY 1, 2""",
    "raw_merge": """SELECT source, lang, doc_id, count(*) OVER w AS merged, n_chars FROM documents WINDOW w AS (PARTITION BY source, lang, coalesce(text, ''))
      QUALIFY row_number() OVER (PARTITION BY source, lang, coalesce(text, '') ORDER BY n_chars DESC, doc_id) = 1""",
    "raw_merge_content": r"""WITH d AS (SELECT *, sha256(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS content FROM documents)
      SELECT source, lang, doc_id, count(*) OVER (PARTITION BY source, lang, content) AS merged, n_chars FROM d
      QUALIFY row_number() OVER (PARTITION BY source, lang, content ORDER BY n_chars DESC, doc_id) = 1""",
    "notifications": f"""WITH {ARTICLES_SQL} SELECT company_id, story, article_id, seen_at FROM articles WHERE seen_at >= TIMESTAMP '2024-01-28' AND negative >= 0.66::DOUBLE
      QUALIFY row_number() OVER (PARTITION BY company_id, story ORDER BY negative DESC, article_id DESC) = 1""",
    "authoritative_pick": f"""WITH {ATTEMPTS_SQL} SELECT company_id, source, attempt_id, succeeded FROM attempts QUALIFY row_number() OVER (PARTITION BY company_id, source ORDER BY succeeded DESC, slot DESC, attempt_id DESC) = 1""",
    "agreement_rate": """WITH r AS (SELECT lang, quality = 1 AS y, NOT contains(text, '!!') AS p FROM documents d JOIN labels l ON l.doc_id = d.doc_id), b AS (SELECT lang, count(*) AS n, avg((y = p)::INT) AS po, avg(y::INT) AS sy, avg(p::INT) AS sp FROM r GROUP BY lang), c AS (SELECT *, sy * sp + (1 - sy) * (1 - sp) AS pe FROM b)
      SELECT lang, n, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM c""",
}
