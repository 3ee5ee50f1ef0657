"""The staged filter over raw items: page type, duplicate, advertising, relevance.

A stage that decides an item ends it; later stages are not evaluated for it. Items
are documents: the first line is the title, the rest the summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.sources.scratch import written
from tidewatch.sources.tables import table

# Advertising rules: pattern, weight, evidence (fixed values).
AD_RULES = [
    ("(?:유료\\s*)?광고(?:입니다|포함|성)?", 0.34, "advertising_disclosure"),
    ("협찬|체험단|공동\\s*구매|공구\\s*(?:오픈|마감)", 0.55, "promotion_disclosure"),
    ("sponsored|paid\\s+partnership", 0.55, "sponsored_english"),
    ("affiliate", 0.45, "affiliate_english"),
    ("(?:지금|바로)\\s*(?:구매|신청)|구매하기|주문하기|buy\\s+now|order\\s+now", 0.42, "purchase_cta"),
    ("무료\\s*(?:상담|체험|견적)|상담\\s*(?:문의|신청)|free\\s+consultation", 0.42, "consultation_cta"),
    ("할인\\s*(?:코드|쿠폰|이벤트)|특가|최저가|선착순", 0.36, "discount_cta"),
    ("카카오톡\\s*(?:채널|문의)|오픈\\s*채팅|dm\\s*(?:문의|주세요)", 0.44, "direct_contact"),
    ("(?:문의|예약)\\s*[:：]?\\s*0[0-9]{1,2}[- )]?[0-9]{3,4}[- ]?[0-9]{4}", 0.50, "phone_contact"),
]
# Hosts of shops and short links (fixed values).
AD_HOSTS = ["shopping.", "smartstore.", "storefarm.", "coupang.", "11st.", "gmarket.", "auction.", "linktr.ee", "bit.ly"]
# Titles of listings, boards and the like (fixed values).
LISTING_TITLES = [
    "(?:^|[\\s)>｜|·-])(?:뉴스|기사|이슈|보도자료)\\s*(?:카테고리|목록|리스트)\\s*$",
    "(?:^|[\\s)>｜|·-])(?:뉴스|기사|보도자료)?\\s*검색\\s*결과\\s*$",
    "종토방|종목토론방|종토넷",
    ">\\s*(?:국내|해외|온라인)?\\s*핫딜\\s*$",
    "베플|베스트\\s*(?:댓글|리플|게시글)|인기\\s*(?:글|댓글)\\s*모음",
]
# Hosts that carry no articles (fixed values).
BOARD_HOSTS = [
    "dcinside.com", "dealbada.com", "diningcode.com", "mangoplate.com", "nate.com", "jongto.net", "adrything.com", "fmkorea.com", "clien.net",
    "ppomppu.co.kr", "ruliweb.com", "theqoo.net", "instiz.net", "todayhumor.co.kr", "82cook.com", "ilbe.com", "ygosu.com", "mlbpark.donga.com",
    "bobaedream.co.kr", "humoruniv.com", "worker.co.kr", "sisopick.com", "ye-ah.net",
]
# Parts of a shop's query (fixed values).
SHOP_QUERIES = ["colorcodes=", "sortcode=", "page_kind=brandshop", "list_kind=small"]
# Bands: advertising that is rejected and reviewed, relevance accepted and rejected (fixed values).
AD_REJECT, AD_REVIEW, ACCEPT, REJECT = 0.85, 0.55, 0.70, 0.30
TITLE_SECONDS = 15 * 60

# Rules for the languages of the documents, which the fixed ones do not know.
LOCAL_AD_RULES = [("licensed under", 0.34, "licence_notice"), ("(?:token|password|secret)\\s*[=:]", 0.42, "secret_notice"), ("[+][0-9][0-9 .()-]{8,}", 0.50, "telephone"), ("[a-z0-9.]+@[a-z0-9-]+\\.[a-z]", 0.36, "mail_contact")]
LOCAL_LISTING_TITLES = ["(?:^|[\\s)>|-])(?:news|index)\\s*$", "(?:^| )(?:search )?results?$"]
#: Terms of the four kinds of company (company_id % 4): names, products; risk words of all.
IDENTITY = [["thor", "eaun"], ["erin", "stand"], ["onan", "eluch"], ["anea", "queau"]]
PRODUCT = [["erst"], ["ering"], ["ernd"], ["erly"]]
RISK_WORDS = ["attion", "erble"]
#: The source whose items are comments: their title is that of what they comment on.
COMMENTS = "src7"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw items: id, company, source, title, summary, url, published_at (missing for
    some) and collected_at."""
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    title = F.substring_index(text, "\n", 1)
    place = F.when(i % 40 == 7, "Shopping.example.com").when(i % 40 == 13, "board.dcinside.com").otherwise(F.concat(F.lit("News-"), F.coalesce("source", F.lit("none")), F.lit(".example.com")))
    path = F.when(i % 3 == 0, F.concat(F.lit("/a/"), F.floor(i / 40).cast("string"))).otherwise(F.concat(F.lit("/b/"), i.cast("string")))
    query = F.when(i % 40 == 21, "?sortCode=3").otherwise(F.concat(F.lit("/?utm_source=x"), i.cast("string"), F.lit("&b=2&A=1&Ref=top#"), i.cast("string")))
    minutes = (i * 37) % 97 * 10 + i % 3
    at = lambda m: (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=m))
    return table(spark, sf_dir, "documents").select(
        i.alias("raw_id"), (i % 50).alias("company_id"), "source", "lang", title.alias("title"), F.substr(text, F.char_length(title) + 2).alias("summary"),
        F.concat(F.lit("HTTPS://"), place, path, query).alias("url"), F.when(i % 5 != 0, at(minutes.cast("int"))).alias("published_at"), at((minutes + 3).cast("int")).alias("collected_at"),
    )


ITEMS_SQL = """items AS (SELECT doc_id AS raw_id, doc_id % 50 AS company_id, source, lang, split_part(coalesce(text, ''), chr(10), 1) AS title, substr(coalesce(text, ''), CAST(length(split_part(coalesce(text, ''), chr(10), 1)) + 2 AS BIGINT)) AS summary,
  'HTTPS://' || CASE WHEN doc_id % 40 = 7 THEN 'Shopping.example.com' WHEN doc_id % 40 = 13 THEN 'board.dcinside.com' ELSE 'News-' || coalesce(source, 'none') || '.example.com' END
    || CASE WHEN doc_id % 3 = 0 THEN '/a/' || (doc_id // 40) ELSE '/b/' || doc_id END || CASE WHEN doc_id % 40 = 21 THEN '?sortCode=3' ELSE '/?utm_source=x' || doc_id || '&b=2&A=1&Ref=top#' || doc_id END AS url,
  CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37) % 97 * 10 + doc_id % 3) END AS published_at, TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37) % 97 * 10 + doc_id % 3 + 3) AS collected_at FROM documents)"""


def with_norms(rows: DataFrame) -> DataFrame:
    """Items with normalised title, summary, both of them, and URL."""
    out = rows.withColumns({"ntitle": T.normalized(F.col("title")), "nsummary": T.normalized(F.col("summary")), "nurl": T.normalized_url(F.col("url"))})
    both = F.concat_ws(" ", F.when(F.col("ntitle") != "", F.col("ntitle")), F.when(F.col("nsummary") != "", F.col("nsummary")))
    return out.withColumn("content", both)


NORMS_SQL = f"""{ITEMS_SQL}, normed AS (SELECT *, concat_ws(' ', nullif(ntitle, ''), nullif(nsummary, '')) AS content FROM (SELECT *, {T.normalized_sql('title')} AS ntitle, {T.normalized_sql('summary')} AS nsummary, {T.normalized_url_sql('url')} AS nurl FROM items))"""


def content_fingerprints(spark, sf_dir):
    """Of each item the digest of its normalised title and summary, that of its old
    form without normalising, and how many different tokens it has."""
    rows = with_norms(items(spark, sf_dir))
    legacy = F.md5(F.concat(F.col("title"), F.lit("\n"), F.col("summary")))
    return rows.select("raw_id", F.sha2(F.concat("ntitle", F.lit("\n"), "nsummary"), 256).alias("content_hash"), legacy.alias("legacy_hash"), F.size(T.tokens(F.col("content"))).cast("long").alias("n_tokens"))


def _listing() -> Column:
    title = F.lit(False)
    for p in LISTING_TITLES + LOCAL_LISTING_TITLES:
        title = title | F.col("ntitle").rlike(p)
    place, query = T.host(F.col("url")), F.lower(F.regexp_extract("url", "^[^?#]*\\?([^#]*)", 1))
    board = F.exists(F.array(*map(F.lit, BOARD_HOSTS)), lambda h: F.contains(place, h))
    shop = F.exists(F.array(*map(F.lit, SHOP_QUERIES)), lambda q: F.contains(query, q))
    return F.when(title, "generic_listing_title").when(board, "non_article_host").when(shop, "ecommerce_listing_query")


def _listing_sql() -> str:
    title = " OR ".join(f"regexp_matches(ntitle, '{p}')" for p in LISTING_TITLES + LOCAL_LISTING_TITLES)
    place = T.host_sql("url")
    board = " OR ".join(f"contains({place}, '{h}')" for h in BOARD_HOSTS)
    shop = " OR ".join(f"contains(lower(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)), '{q}')" for q in SHOP_QUERIES)
    return f"CASE WHEN {title} THEN 'generic_listing_title' WHEN {board} THEN 'non_article_host' WHEN {shop} THEN 'ecommerce_listing_query' END"


def page_types(spark, sf_dir):
    """Items that are no article but a listing, a board or a shop's page, and why."""
    rows = with_norms(items(spark, sf_dir)).select("raw_id", _listing().alias("page_type"))
    return rows.where(F.col("page_type").isNotNull())


def first_near(rows: DataFrame) -> DataFrame:
    """(raw_id, of_title): of each row (raw_id, title, published, collected; seconds) the
    smallest id below its own that has its title and was published, or else collected,
    within fifteen minutes.

    Both times count where both are there, else both collection times. Windows over
    a title's rows in order of time look fifteen minutes to either side. They stand
    for one day at a time, and rows near midnight stand in the next day too, so no
    window holds all rows of a title that is used for ever."""

    def near(at: str, of: DataFrame, asking: Column, counting: Column) -> DataFrame:
        day = lambda t: F.floor(t / 86_400)
        days = F.array_distinct(F.array(day(F.col(at)), day(F.col(at) - TITLE_SECONDS), day(F.col(at) + TITLE_SECONDS)))
        spread = of.withColumn("day", F.explode(days))
        around = Window.partitionBy("title", "day").orderBy(at).rangeBetween(-TITLE_SECONDS, TITLE_SECONDS)
        found = spread.withColumn("first", F.min(F.when(counting, F.col("raw_id"))).over(around))
        return found.where(asking & (F.col("day") == day(F.col(at)))).select("raw_id", "first")

    dated, undated = F.col("published").isNotNull(), F.col("published").isNull()
    found = near("published", rows.where(dated), F.lit(True), F.lit(True)).unionByName(near("collected", rows, dated, undated)).unionByName(near("collected", rows, undated, F.lit(True)))
    return found.where("first < raw_id").groupBy("raw_id").agg(F.min("first").alias("of_title"))


def seconds(at: str) -> Column:
    return F.unix_seconds(F.col(at).cast("timestamp"))


def duplicates(rows: DataFrame) -> DataFrame:
    """Rows of `with_norms` with duplicate_of and evidence: an earlier item of the same
    URL, or of the same title within fifteen minutes; the smallest id counts.

    What tells copies, digests and times, is a table in the shared folder, as several
    windows read it: so texts are read and normalised once for it, and once for the rest."""
    speaks = (F.col("ntitle") != "") & ~F.coalesce(F.lower(F.trim("source")) == COMMENTS, F.lit(False))
    keys = written(rows.select("raw_id", F.when(F.col("nurl") != "", F.col("nurl")).alias("nurl"), F.when(speaks, F.md5("ntitle")).alias("title"), seconds("published_at").alias("published"), seconds("collected_at").alias("collected")))
    of_url = keys.where("nurl IS NOT NULL").groupBy("nurl").agg(F.min("raw_id").alias("of_url"))
    of_url = keys.join(of_url, "nurl").where("of_url < raw_id").groupBy("raw_id", "nurl").agg(F.min("of_url").alias("of_url"))
    of_title = first_near(keys.where("title IS NOT NULL").select("raw_id", "title", "published", "collected"))
    out = rows.join(of_url, ["raw_id", "nurl"], "left").join(of_title, "raw_id", "left")
    first = F.least("of_url", "of_title")
    evidence = F.when(F.col("of_url") == first, "same_normalized_url").when(first.isNotNull(), "same_title_within_15_minutes")
    return out.withColumns({"duplicate_of": first, "duplicate_evidence": evidence}).drop("of_url", "of_title")


_DUPLICATES_SQL = f"""speaking AS (SELECT raw_id, ntitle, published_at, collected_at FROM normed WHERE ntitle <> '' AND coalesce(lower(trim(source)), '') <> '{COMMENTS}'),
  of_title AS (SELECT a.raw_id, min(b.raw_id) AS of_title FROM speaking a JOIN speaking b ON a.ntitle = b.ntitle AND b.raw_id < a.raw_id
    AND CASE WHEN a.published_at IS NOT NULL AND b.published_at IS NOT NULL THEN abs(epoch(a.published_at) - epoch(b.published_at)) ELSE abs(epoch(a.collected_at) - epoch(b.collected_at)) END <= {TITLE_SECONDS} GROUP BY 1),
  of_url AS (SELECT nurl, min(raw_id) AS of_url FROM normed WHERE nurl <> '' GROUP BY 1),
  marked AS (SELECT n.*, least(u.of_url, t.of_title) AS duplicate_of, CASE WHEN u.of_url = least(u.of_url, t.of_title) THEN 'same_normalized_url' WHEN least(u.of_url, t.of_title) IS NOT NULL THEN 'same_title_within_15_minutes' END AS duplicate_evidence
    FROM normed n LEFT JOIN of_title t USING (raw_id) LEFT JOIN of_url u ON n.nurl = u.nurl AND u.of_url < n.raw_id)"""


def filter_duplicates(spark, sf_dir):
    """Items that repeat an earlier one, by URL or by title and time."""
    return duplicates(with_norms(items(spark, sf_dir))).where(F.col("duplicate_of").isNotNull()).select("raw_id", "duplicate_of", "duplicate_evidence")


def _ad_score() -> Column:
    hits = [F.when(F.col("content").rlike(p), w).otherwise(0.0) for p, w, _ in AD_RULES + LOCAL_AD_RULES]
    place = T.host(F.col("url"))
    shop = F.exists(F.array(*map(F.lit, AD_HOSTS)), lambda h: F.contains(place, h))
    total = F.when(shop, 0.55).otherwise(0.0)
    for h in hits:
        total = total + h
    return F.round(F.least(total, F.lit(1.0)), 6)


def _ad_score_sql() -> str:
    place = T.host_sql("url")
    shop = " OR ".join(f"contains({place}, '{h}')" for h in AD_HOSTS)
    total = f"CASE WHEN {shop} THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END" + "".join(f" + CASE WHEN regexp_matches(content, '{p}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for p, w, _ in AD_RULES + LOCAL_AD_RULES)
    return f"round(least({total}, 1.0::DOUBLE), 6)"


def filter_ads(spark, sf_dir):
    """Advertising score of each item by weighted rules, and what spoke for it."""
    place = T.host(F.col("url"))
    told = [F.when(F.col("content").rlike(p), F.lit(code)) for p, _, code in AD_RULES + LOCAL_AD_RULES]
    told.append(F.when(F.exists(F.array(*map(F.lit, AD_HOSTS)), lambda h: F.contains(place, h)), F.lit("commerce_or_redirect_host")))
    return with_norms(items(spark, sf_dir)).select("raw_id", _ad_score().alias("ad_score"), F.concat_ws(",", *told).alias("evidence"))


def _by_kind(pick) -> Column:
    out = F.lit(False)
    for k in range(4):
        out = F.when(F.col("company_id") % 4 == k, pick(k)).otherwise(out)
    return out


def _any_term(column: str, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | T.holds_term(F.col(column), t)
    return out


def _mentions() -> dict[str, Column]:
    """Where an item names its company or its products."""
    named = {"identity": IDENTITY, "product": PRODUCT}
    return {f"{kind}_in_{where}": _by_kind(lambda k, t=terms, c=column: _any_term(c, t[k])) for kind, terms in named.items() for where, column in (("title", "ntitle"), ("summary", "nsummary"))}


def _mentions_sql() -> str:
    one = lambda column, terms: "(" + " OR ".join(T.holds_term_sql(column, t) for t in terms) + ")"
    by_kind = lambda column, terms: "CASE company_id % 4 " + " ".join(f"WHEN {k} THEN {one(column, terms[k])}" for k in range(4)) + " END"
    return ", ".join(f"{by_kind(column, terms)} AS {kind}_in_{where}" for kind, terms in (("identity", IDENTITY), ("product", PRODUCT)) for where, column in (("title", "ntitle"), ("summary", "nsummary"))) + f", {one('content', RISK_WORDS)} AS risk_support"


def _rule_relevance() -> Column:
    """Relevance by where the company and its products are named; a risk word adds."""
    score = F.greatest(
        F.when(F.col("identity_in_title"), 0.96).when(F.col("identity_in_summary"), 0.84).otherwise(0.0),
        F.when(F.col("product_in_title"), 0.82).when(F.col("product_in_summary"), 0.68).otherwise(0.0),
    )
    return F.round(F.when(F.col("risk_support"), F.least(score + 0.05, F.lit(1.0))).otherwise(score), 6)


_RULE_RELEVANCE_SQL = """round(CASE WHEN risk_support THEN least(greatest(CASE WHEN identity_in_title THEN 0.96::DOUBLE WHEN identity_in_summary THEN 0.84::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN product_in_title THEN 0.82::DOUBLE WHEN product_in_summary THEN 0.68::DOUBLE ELSE 0.0::DOUBLE END) + 0.05::DOUBLE, 1.0::DOUBLE)
  ELSE greatest(CASE WHEN identity_in_title THEN 0.96::DOUBLE WHEN identity_in_summary THEN 0.84::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN product_in_title THEN 0.82::DOUBLE WHEN product_in_summary THEN 0.68::DOUBLE ELSE 0.0::DOUBLE END) END, 6)"""


def _with_mentions(rows: DataFrame) -> DataFrame:
    return rows.withColumns(_mentions() | {"risk_support": _any_term("content", RISK_WORDS)})


def filter_relevance(spark, sf_dir):
    """Relevance of each item to its company by rules, and where it is named."""
    rows = _with_mentions(with_norms(items(spark, sf_dir)))
    return rows.select("raw_id", "company_id", "identity_in_title", "identity_in_summary", "product_in_title", "product_in_summary", "risk_support", _rule_relevance().alias("relevance"))


def staged(rows: DataFrame) -> DataFrame:
    """Decisions on rows of `duplicates`. Each score is told only where its stage was
    reached, else 0: a CASE looks at a later branch only if none before held."""
    rows = rows.withColumn("page_type", _listing())
    rows = rows.withColumn("ad_score", F.when(F.col("page_type").isNotNull() | F.col("duplicate_of").isNotNull(), 0.0).otherwise(_ad_score()))
    reached = F.col("page_type").isNull() & F.col("duplicate_of").isNull() & (F.col("ad_score") < AD_REVIEW)
    rows = _with_mentions(rows).withColumn("relevance", F.when(reached, _rule_relevance()).otherwise(0.0))
    stage = F.when(F.col("page_type").isNotNull(), "page_type").when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("ad_score") >= AD_REVIEW, "advertising").otherwise("relevance")
    rows = rows.withColumn("stopped_at", stage)
    at = lambda s: F.col("stopped_at") == s
    decision = F.when(at("page_type") | at("duplicate"), "rejected").when(at("advertising"), F.when(F.col("ad_score") >= AD_REJECT, "rejected").otherwise("review_required"))
    decision = decision.when(F.col("relevance") >= ACCEPT, "accepted").when(F.col("relevance") <= REJECT, "rejected").otherwise("review_required")
    reason = F.when(at("page_type"), "irrelevant").when(at("duplicate"), "duplicate").when(at("advertising"), "advertisement").when(F.col("relevance") >= ACCEPT, "accepted").otherwise("irrelevant")
    middle = F.abs(F.col("relevance") - (ACCEPT + REJECT) / 2) + 0.5
    confidence = F.when(at("page_type") | at("duplicate"), 1.0).when(at("advertising"), F.greatest(F.lit(0.5), F.col("ad_score"))).when(F.col("relevance") >= ACCEPT, F.col("relevance")).when(F.col("relevance") <= REJECT, 1.0 - F.col("relevance")).otherwise(middle)
    return rows.select("raw_id", "company_id", "source", "stopped_at", decision.alias("decision"), reason.alias("reason"), "duplicate_of", "ad_score", "relevance", F.round(confidence, 6).alias("confidence"))


def filter_stages(spark, sf_dir):
    """Each item's decision, its reason, the stage that took it, scores, confidence."""
    return staged(duplicates(with_norms(items(spark, sf_dir)))).drop("source")


_STAGES_SQL = f"""{NORMS_SQL}, {_DUPLICATES_SQL},
  typed AS (SELECT *, {_listing_sql()} AS page_type, {_mentions_sql()} FROM marked),
  scored AS (SELECT *, CASE WHEN page_type IS NOT NULL OR duplicate_of IS NOT NULL THEN 0.0::DOUBLE ELSE {_ad_score_sql()} END AS ad_score FROM typed),
  ranked AS (SELECT *, CASE WHEN page_type IS NULL AND duplicate_of IS NULL AND ad_score < {AD_REVIEW}::DOUBLE THEN {_RULE_RELEVANCE_SQL} ELSE 0.0::DOUBLE END AS relevance,
    CASE WHEN page_type IS NOT NULL THEN 'page_type' WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN ad_score >= {AD_REVIEW}::DOUBLE THEN 'advertising' ELSE 'relevance' END AS stopped_at FROM scored),
  stages AS (SELECT raw_id, company_id, source, stopped_at, CASE WHEN stopped_at IN ('page_type', 'duplicate') THEN 'rejected' WHEN stopped_at = 'advertising' THEN CASE WHEN ad_score >= {AD_REJECT}::DOUBLE THEN 'rejected' ELSE 'review_required' END WHEN relevance >= {ACCEPT}::DOUBLE THEN 'accepted' WHEN relevance <= {REJECT}::DOUBLE THEN 'rejected' ELSE 'review_required' END AS decision,
    CASE stopped_at WHEN 'page_type' THEN 'irrelevant' WHEN 'duplicate' THEN 'duplicate' WHEN 'advertising' THEN 'advertisement' ELSE CASE WHEN relevance >= {ACCEPT}::DOUBLE THEN 'accepted' ELSE 'irrelevant' END END AS reason, duplicate_of, ad_score, relevance,
    round(CASE WHEN stopped_at IN ('page_type', 'duplicate') THEN 1.0::DOUBLE WHEN stopped_at = 'advertising' THEN greatest(0.5::DOUBLE, ad_score) WHEN relevance >= {ACCEPT}::DOUBLE THEN relevance WHEN relevance <= {REJECT}::DOUBLE THEN 1.0::DOUBLE - relevance ELSE 0.5::DOUBLE + abs(relevance - {(ACCEPT + REJECT) / 2}::DOUBLE) END, 6) AS confidence FROM ranked)"""


def filter_inherited(spark, sf_dir):
    """Duplicates with the decision of the item they repeat; they are merged into it if
    it is accepted and no advertising is suspected."""
    rows = written(filter_stages(spark, sf_dir))  # decisions without texts, read twice
    first = rows.select(F.col("raw_id").alias("duplicate_of"), F.col("decision").alias("first_decision"), F.col("relevance").alias("first_relevance"), F.col("ad_score").alias("first_ad"))
    merge = (F.col("first_relevance") >= ACCEPT) & (F.col("first_ad") < AD_REVIEW) & (F.col("first_decision") == "accepted")
    return rows.where("stopped_at = 'duplicate'").join(first, "duplicate_of").select("raw_id", "duplicate_of", "first_decision", "first_relevance", F.when(merge, "merge").otherwise("keep_rejected").alias("action"))


def _calibrated(score: Column, reject: float, accept: float) -> Column:
    """A model's score on the bands of the filter: its own thresholds become .3 and .7."""
    low, mid = score * (0.30 / reject), (score - reject) * (0.40 / (accept - reject)) + 0.30
    return F.when(score <= reject, low).when(score < accept, mid).otherwise((score - accept) * (0.30 / (1.0 - accept)) + 0.70)


def filter_blend(spark, sf_dir):
    """Rule relevance blended with a model's score, which its thresholds calibrate:
    companies that the model knows trust it more, mentions in the body are capped."""
    rows = filter_relevance(spark, sf_dir)
    known = F.col("company_id") % 4 < 2
    model = _calibrated((F.col("raw_id") * 37 % 101) / 100, 0.25, 0.65)
    r, m = F.col("relevance"), F.col("model")
    body = ~F.col("identity_in_title") & ~F.col("product_in_title") & (F.col("identity_in_summary") | F.col("product_in_summary"))
    out = F.when(F.col("identity_in_title") & known, F.greatest(F.lit(0.76), r * 0.45 + m * 0.55)).when(F.col("identity_in_title"), F.greatest(F.lit(0.60), r * 0.65 + m * 0.35))
    out = out.when(F.col("product_in_title") & known, F.greatest(F.lit(0.70), r * 0.35 + m * 0.65)).when(F.col("product_in_title"), F.greatest(F.lit(0.55), r * 0.60 + m * 0.40))
    out = out.when(body, F.least(F.lit(0.55), r * 0.30 + m * 0.70)).when(r > 0, r * 0.25 + m * 0.75).otherwise(F.least(F.lit(0.30), m * 0.55))
    return rows.withColumn("model", model).select("raw_id", F.round("model", 6).alias("model"), F.round(out, 6).alias("blended"))


def filter_stage_counts(spark, sf_dir):
    """How many items each stage took, by decision and language of their source."""
    return staged(duplicates(with_norms(items(spark, sf_dir)))).groupBy("source", "stopped_at", "decision").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("confidence"), 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (content_fingerprints, page_types, filter_duplicates, filter_ads, filter_relevance, filter_stages, filter_inherited, filter_blend, filter_stage_counts)}

_TOLD_SQL = ", ".join([f"CASE WHEN regexp_matches(content, '{p}') THEN '{code}' END" for p, _, code in AD_RULES + LOCAL_AD_RULES] + ["CASE WHEN " + " OR ".join(f"contains({T.host_sql('url')}, '{h}')" for h in AD_HOSTS) + " THEN 'commerce_or_redirect_host' END"])
ORACLE_SQL = {
    "content_fingerprints": f"WITH {NORMS_SQL} SELECT raw_id, sha256(ntitle || chr(10) || nsummary) AS content_hash, md5(title || chr(10) || summary) AS legacy_hash, CAST(len({T.tokens_sql('content')}) AS BIGINT) AS n_tokens FROM normed",
    "page_types": f"WITH {NORMS_SQL}, t AS (SELECT raw_id, {_listing_sql()} AS page_type FROM normed) SELECT * FROM t WHERE page_type IS NOT NULL",
    "filter_duplicates": f"WITH {NORMS_SQL}, {_DUPLICATES_SQL} SELECT raw_id, duplicate_of, duplicate_evidence FROM marked WHERE duplicate_of IS NOT NULL",
    "filter_ads": f"WITH {NORMS_SQL} SELECT raw_id, {_ad_score_sql()} AS ad_score, concat_ws(',', {_TOLD_SQL}) AS evidence FROM normed",
    "filter_relevance": f"WITH {NORMS_SQL}, m AS (SELECT *, {_mentions_sql()} FROM normed) SELECT raw_id, company_id, identity_in_title, identity_in_summary, product_in_title, product_in_summary, risk_support, {_RULE_RELEVANCE_SQL} AS relevance FROM m",
    "filter_stages": f"WITH {_STAGES_SQL} SELECT * EXCLUDE (source) FROM stages",
    "filter_inherited": f"""WITH {_STAGES_SQL} SELECT d.raw_id, d.duplicate_of, f.decision AS first_decision, f.relevance AS first_relevance, CASE WHEN f.relevance >= {ACCEPT}::DOUBLE AND f.ad_score < {AD_REVIEW}::DOUBLE AND f.decision = 'accepted' THEN 'merge' ELSE 'keep_rejected' END AS action
      FROM stages d JOIN stages f ON d.duplicate_of = f.raw_id WHERE d.stopped_at = 'duplicate'""",
    "filter_blend": f"""WITH {NORMS_SQL}, m AS (SELECT *, {_mentions_sql()} FROM normed), r AS (SELECT *, {_RULE_RELEVANCE_SQL} AS r, (raw_id * 37 % 101) / 100 AS s, company_id % 4 < 2 AS known, NOT identity_in_title AND NOT product_in_title AND (identity_in_summary OR product_in_summary) AS body FROM m),
      c AS (SELECT *, CASE WHEN s <= 0.25::DOUBLE THEN s * (0.30::DOUBLE / 0.25::DOUBLE) WHEN s < 0.65::DOUBLE THEN (s - 0.25::DOUBLE) * (0.40::DOUBLE / (0.65::DOUBLE - 0.25::DOUBLE)) + 0.30::DOUBLE ELSE (s - 0.65::DOUBLE) * (0.30::DOUBLE / (1.0::DOUBLE - 0.65::DOUBLE)) + 0.70::DOUBLE END AS m FROM r)
      SELECT raw_id, round(m, 6) AS model, round(CASE WHEN identity_in_title AND known THEN greatest(0.76::DOUBLE, r * 0.45::DOUBLE + m * 0.55::DOUBLE) WHEN identity_in_title THEN greatest(0.60::DOUBLE, r * 0.65::DOUBLE + m * 0.35::DOUBLE)
        WHEN product_in_title AND known THEN greatest(0.70::DOUBLE, r * 0.35::DOUBLE + m * 0.65::DOUBLE) WHEN product_in_title THEN greatest(0.55::DOUBLE, r * 0.60::DOUBLE + m * 0.40::DOUBLE) WHEN body THEN least(0.55::DOUBLE, r * 0.30::DOUBLE + m * 0.70::DOUBLE)
        WHEN r > 0 THEN r * 0.25::DOUBLE + m * 0.75::DOUBLE ELSE least(0.30::DOUBLE, m * 0.55::DOUBLE) END, 6) AS blended FROM c""",
    "filter_stage_counts": f"WITH {_STAGES_SQL} SELECT source, stopped_at, decision, count(*) AS items, round(avg(confidence), 6) AS confidence FROM stages GROUP BY ALL",
}
