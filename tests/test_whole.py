"""Results that a cut in the operators would change."""

import datetime as dt

import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators import filtering, lifecycle, rollups, series, texts

EVENTS = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string"


@pytest.fixture
def tables(spark, tmp_path):
    """Writes small tables and gives their folder."""

    def put(**rows):
        for name, (schema, values) in rows.items():
            spark.createDataFrame(values, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


def test_texts_with_one_beginning_stay_apart(spark, tables):
    same = "The same forty characters begin each text"
    texts = [f"{same}: rain.", f"{same}: sun.", f"{same}:  sun. ", f"{same}: sun."]
    d = tables(documents=("doc_id long, text string, lang string, source string, n_chars long", [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]))
    got = sorted(tuple(r) for r in lifecycle.raw_merge_content(spark, d).collect())
    assert got == [("web", "en", 0, 1, len(texts[0])), ("web", "en", 2, 3, len(texts[2]))]


def test_short_words_count(spark, tables):
    d = tables(benchmark=("item_id long, text string", [(1, "we go to town"), (2, "we go on"), (3, "Town\n"), (4, "else")]))
    got = sorted(tuple(r) for r in texts.token_jaccard_pairs(spark, d).collect())
    assert got == [(1, 2, 0.4), (1, 3, 0.25)]


@pytest.mark.parametrize("at_least", [0.0, 0.1, 0.3, 0.5, 1.0])
def test_first_words_miss_no_pair(spark, at_least):
    import random

    draw = random.Random(7)
    sets = {i: sorted({f"w{int(30 * draw.random() ** 2)}" for _ in range(draw.randint(1, 30))}) for i in range(60)}
    sets[60] = sets[3]
    got = {(r["a"], r["b"]): r["jaccard"] for r in texts.jaccard_pairs(spark.createDataFrame(list(sets.items()), "item_id long, words array<string>"), at_least).collect()}
    share = {(a, b): len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a in sets for b in sets if a < b}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in share.items() if v > 0 and v >= at_least - 1e-9}


def test_all_queries_of_the_search_over_shards(spark, duck, monkeypatch):
    monkeypatch.setattr(texts, "SHARD_ROWS", 60)
    monkeypatch.setattr(texts, "BLOCK_QUERIES", 3)
    df = texts.vector_relative_cut_all(spark, SF)
    asked = {r["query_id"] for r in df.collect()}
    assert len(asked) > 1 and max(asked) >= 50
    same(df, duck, texts.ORACLE_SQL["vector_relative_cut_all"])


def test_no_value_holds_a_whole_company(spark, duck):
    df = rollups.row_set_checksum(spark, SF)
    same(df, duck, rollups.ORACLE_SQL["row_set_checksum"])
    assert "collect_list" not in df._jdf.queryExecution().executedPlan().toString()


def test_checksum_over_many_ranges_and_batches(spark, tables):
    import hashlib
    from collections import defaultdict

    events = [(i, 7 if i % 3 else i, dt.datetime(2024, 1, 1), "view", float(i % 100), '{"k": 1}') for i in range(3000)]
    d = tables(events=(EVENTS, events))
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r["company_id"]: r["digest"] for r in rollups.row_set_checksum(spark, d).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = defaultdict(list)
    for i, u, _, kind, value, _ in events:
        label = "negative" if value / 100 >= 0.66 else "neutral" if value / 100 >= 0.33 else "positive"
        want[u % 50].append(hashlib.sha256(f"{i}|{kind}|{label}".encode()).hexdigest())
    assert got == {k: hashlib.sha256(",".join(sorted(v)).encode()).hexdigest() for k, v in want.items()}


def test_duplicates_within_fifteen_minutes(spark, tables):
    """Ids that 77 divides are never published, so their creation counts."""
    start = dt.datetime(2024, 1, 1, 23, 50)
    kinds = [(1, "view", 0), (2, "signup", 2), (4, "view", 5), (5, "view", 30), (6, "signup", 31), (7, "view", 46), (8, "view", -9), (9, "view", 15)]
    d = tables(events=(EVENTS, [(77 * i, 7, start + dt.timedelta(minutes=m), kind, 1.0, '{"k": 1}') for i, kind, m in kinds]))
    got = {r["article_id"] // 77: r["duplicate_of"] and r["duplicate_of"] // 77 for r in lifecycle.duplicate_rule(spark, d).collect()}
    assert got == {1: None, 2: None, 4: 1, 5: None, 6: None, 7: None, 8: 1, 9: 1}


ITEM = "raw_id long, company_id long, source string, title string, summary string, url string, published_at timestamp_ntz, collected_at timestamp_ntz"


def staged(spark, rows):
    at = dt.datetime(2024, 1, 1, 12)
    full = [(i, 0, source, title, summary, url, None if m is None else at + dt.timedelta(minutes=m), at + dt.timedelta(minutes=c)) for i, source, title, summary, url, m, c in rows]
    out = filtering.staged(filtering.duplicates(filtering.with_norms(spark.createDataFrame(full, ITEM))))
    return {r["raw_id"]: r for r in out.collect()}


def test_stages_of_the_filter(spark):
    """Tracking parameters, mentions, listings, advertising, duplicates, comments."""
    got = staged(spark, [
        (1, "news", "Thor opens", "eaun said", "https://News.example/a?b=2&utm_source=x&a=1#top", 0, 1), (2, "web", "Other", "words", "https://news.example/a/?a=1&b=2&fbclid=3", 500, 501),
        (3, "web", "Nothing here", "at all", "https://n.example/3", 900, 900), (4, "web", "회사 검색 결과", "thor", "https://n.example/4", 1000, 1000),
        (5, "web", "thor sponsored", "buy now", "https://n.example/5", 1100, 1100), (6, "web", "thor", "affiliate", "https://shopping.example/6", 1200, 1200),
        (7, "web", "Same title", "x", "https://n.example/7", 2000, 2000), (8, "web", "same  TITLE", "y", "https://n.example/8", 2014, 2014), (9, "web", "Same title", "z", "https://n.example/9", 2040, 2040),
        (10, "src7", "Same title", "c", "https://n.example/10", 2001, 2001), (11, "web", "x", "the erst thing", "https://n.example/11", None, 3000), (12, "web", "thorough", "", "https://n.example/12", 3100, 3100),
    ])
    assert (got[1]["decision"], got[1]["reason"], got[1]["relevance"]) == ("accepted", "accepted", 0.96)
    assert (got[2]["stopped_at"], got[2]["duplicate_of"]) == ("duplicate", 1)
    assert (got[3]["decision"], got[3]["reason"], got[3]["confidence"]) == ("rejected", "irrelevant", 1.0)
    assert (got[4]["stopped_at"], got[4]["ad_score"], got[4]["relevance"]) == ("page_type", 0.0, 0.0)
    assert (got[5]["decision"], got[5]["reason"], got[5]["ad_score"], got[5]["relevance"]) == ("rejected", "advertisement", 0.97, 0.0)
    assert got[6]["ad_score"] == 1.0 and got[6]["stopped_at"] == "advertising"
    assert got[8]["duplicate_of"] == 7 and got[9]["duplicate_of"] is None and got[7]["duplicate_of"] is None and got[10]["duplicate_of"] is None
    assert (got[11]["decision"], got[11]["relevance"], got[11]["confidence"]) == ("review_required", 0.68, 0.68)
    assert got[12]["relevance"] == 0.0


def test_filter_on_nulls_and_empty_tables(spark):
    got = staged(spark, [(1, None, None, None, None, None, 0), (2, None, "", "", "", 1, 1)])
    assert {r["reason"] for r in got.values()} == {"irrelevant"}
    assert staged(spark, []) == {}


def test_addresses(spark):
    urls = ["HTTPS://News.Example/Path/?b=2&UTM_Campaign=x&a=1&IGSHID=3&source=q#f", "https://e.org", "", None, "https://u:p@WWW.blog.site.go.kr:8080/x//", "mailto:x"]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", T.normalized_url(F.col("u")), T.source_domain(F.col("u")), T.credibility(T.source_domain(F.col("u"))), T.bare_url(F.col("u"))).collect()
    got = {r[0]: tuple(r)[1:] for r in got}
    assert got[0] == ("https://news.example/Path?a=1&b=2", "news.example", 0.65, "news.example/path/?b=2&utm_campaign=x&a=1&igshid=3&source=q#f")
    assert got[1][:2] == ("https://e.org/", "e.org") and got[2][:3] == got[3][:3] == ("", "unknown", 0.35)
    assert got[4][1:3] == ("blog.site.go.kr", 0.95) and got[5][1] == "unknown"


def test_similarities(spark):
    sets = [([], []), (["a"], []), (["a", "b"], ["b", "c", "d"])]
    got = [tuple(r) for r in spark.createDataFrame(sets, "a array<string>, b array<string>").select(T.jaccard(F.col("a"), F.col("b")), T.containment(F.col("a"), F.col("b")), T.dice(F.col("a"), F.col("b"))).collect()]
    assert got == [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.25, 0.5, 0.4)]
    grams = [r[0] for r in spark.createDataFrame([("",), ("ab",), ("abcab",)], "t string").select(T.trigrams(F.col("t"))).collect()]
    assert grams == [[], ["ab"], ["abc", "bca", "cab"]]
    norm = [r[0] for r in spark.createDataFrame([("<b>A&amp;B</b>  ﬁn\u00a0Straße",), (None,)], "t string").select(T.normalized_nfkc(F.col("t"))).collect()]
    assert norm == ["a&b fin strasse", ""]


@pytest.mark.parametrize(("recent", "baseline", "shift"), [([1.0] * 7, [1.0] * 40, None), ([3.0] * 8, [1.0] * 39, None), ([3.0] * 8, [1.0] * 40, 2.0), ([3.0] * 8, [1.0] * 25 + [5.0] * 15, 0.5), ([10.0] * 8, [float(i % 9) for i in range(45)], 6 / (2 * 1.4826))])
def test_robust_shift(spark, recent, baseline, shift):
    df = spark.createDataFrame([(recent, baseline)], "r array<double>, b array<double>")
    assert series.with_robust_shift(df, "r", "b").first()["shift"] == (shift if shift is None else pytest.approx(shift))


def test_hysteresis(spark, tables):
    """One event over a gap of 30 minutes, another after 45, closed by two lows."""
    at = dt.datetime(2024, 1, 1)
    windows = [(0, 90), (45, 70), (105, 80), (120, 10), (135, 60), (150, 10), (165, 10), (180, 99)]
    d = tables(events=(EVENTS, [(77 * (i + 1), 7, at + dt.timedelta(minutes=m), "view", float(v), '{"k": 1}') for i, (m, v) in enumerate(windows)]))
    got = sorted((int((r["opened_at"] - at).total_seconds() // 60), int((r["last_seen_at"] - at).total_seconds() // 60), r["severity"], r["closed_at"] and int((r["closed_at"] - at).total_seconds() // 60)) for r in series.hysteresis_events(spark, d).collect())
    assert got == [(0, 60, "critical", 180), (105, 120, "warning", 180), (180, 195, "critical", None)]


def test_one_class_has_no_curve(spark, tables):
    d = tables(documents=("doc_id long, text string, lang string, source string, n_chars long", [(1, "a", "en", "s", 1)]), labels=("doc_id long, quality int, toxic int", [(1, 1, 0)]))
    assert texts.rank_auc(spark, d).first()["auc"] is None
