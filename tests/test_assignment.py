"""Stories as articles arrive: replay, stream and a plain run in order agree."""

import datetime as dt
import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import stories
from tidewatch.streaming import assignment

ITEM = "raw_id long, company_id long, title string, summary string, published_at timestamp_ntz, collected_at timestamp_ntz"
WORDS = "thor erin onan plant stops fire crew anea".split()


def made(n, seed=1):
    """Items whose titles share words, with nulls, equal times and repeated titles."""
    draw, at, rows = random.Random(seed), dt.datetime(2024, 1, 1), []
    for i in range(n):
        title = draw.choice([" ".join(draw.sample(WORDS, draw.choice([1, 3, 4, 5]))), "plant stops again", None, ""])
        summary = draw.choice(["", None, " ".join(draw.sample(WORDS, 6))])
        when = at + dt.timedelta(hours=draw.choice([0, 5, 100, 160, 400, 719, 721, 800, 1500, 2200, 2201]))
        rows.append((i, i % 3 if i % 7 else 0, title, summary, when if i % 4 else None, when))
    return rows


def plain(rows, compared=80, candidates=1500):
    """Each item in order of time and id against all that may be joined: raw_id to (parent, similarity), with no shortcut."""
    tidy = lambda s: re.sub(r"\s+", " ", s or "").strip().lower()
    tokens = lambda s: {t for t in re.findall("[0-9A-Za-z가-힣]+", s) if len(t) > 1 and t not in stories.STOP_TOKENS}
    joined = lambda s: "".join(re.findall("[0-9A-Za-z가-힣]+", s))
    grams = lambda s: {s} - {""} if len(s) <= 3 else {s[i : i + 3] for i in range(len(s) - 2)}
    cont = lambda x, y: len(x & y) / min(len(x), len(y)) if x and y else 0.0
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0
    concepts = lambda t, s: {k: w for k, words, w in stories.CONCEPTS if any(x in f"{t} {s}" for x in words)}

    def lex(a, b):
        (ta, ba), (tb, bb) = a, b
        if not ta or not tb:
            return 0.0
        if joined(ta) == joined(tb):
            return 1.0
        ratio = difflib.SequenceMatcher(None, joined(ta), joined(tb)).ratio()
        title = max(0.52 * cont(tokens(ta), tokens(tb)) + 0.48 * dice(grams(joined(ta)), grams(joined(tb))), 0.55 * ratio + 0.45 * jac(tokens(ta), tokens(tb)))
        if not ba or not bb:
            return round(title, 6)
        return round(min(1, 0.78 * title + 0.22 * max(0.55 * cont(tokens(ba), tokens(bb)) + 0.45 * jac(tokens(ba), tokens(bb)), dice(grams(joined(ba)), grams(joined(bb))))), 6)

    found, told = {}, {}
    ordered = sorted(((p or c, i, company, (tidy(t), tidy(s)[: stories.BODY])) for i, company, t, s, p, c in rows), key=lambda x: x[:2])
    for when, i, company, text in ordered:
        seen = told.setdefault(company, [])
        near = [x for x in reversed(seen[-candidates:]) if when - x[0] <= dt.timedelta(hours=stories.FOLLOW_UP)]
        ranked = []
        for at, other, theirs in near:
            shared = concepts(*text).keys() & concepts(*theirs).keys()
            ranked.append((lex(text, theirs), shared, at, other, theirs))
        ranked.sort(key=lambda x: -(x[0] + min(0.15, 0.025 * len(x[1]))))
        best = None
        for value, shared, at, other, theirs in ranked[:compared]:
            hours, weight = (when - at).total_seconds() / 3600, sum(concepts(*text)[k] for k in shared)
            high = sum(k.startswith(("action:", "incident:")) for k in shared)
            exact = joined(text[0]) != "" and joined(text[0]) == joined(theirs[0])
            recent = value >= 0.66 or (value >= 0.43 and high >= 1 and weight >= 1.8) or (value >= 0.30 and high >= 2 and weight >= 3.0)
            if exact or (recent if hours <= stories.RECENT else value >= 0.78):
                score = 1.0 if exact else round(min(1, 0.6 * value + 0.1 * min(1, weight / 5)), 6)
                if best is None or score > best[1]:
                    best = (other, score)
        found[i] = best or (None, 1.0)
        seen.append((when, i, text))
    return found


def ends(parents):
    def end(i):
        return i if parents[i][0] is None else end(parents[i][0])

    return {i: end(i) for i in parents}


def test_replay_against_plain_run(spark):
    rows = made(150)
    ready = assignment.ready(spark.createDataFrame(rows, ITEM))
    want = plain(rows)
    got = {r["raw_id"]: (r["parent"], r["similarity"]) for r in assignment.parents(ready).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in want)
    assert sum(p is not None for p, _ in want.values()) > 40
    names = {r["raw_id"]: r["fingerprint"] for r in ready.collect()}
    found = {r["raw_id"]: (r["story"], r["representative"]) for r in assignment.assigned(ready).collect()}
    assert found == {i: (names[end], want[i][0] is None) for i, end in ends(want).items()}


def test_limits_of_candidates(spark, monkeypatch):
    """Few candidates, fewer compared: the lazy order of bounds drops the same ones."""
    rows = [(i, 0, t, s, w, w) for i, (_, _, t, s, _, w) in enumerate(made(90, 2))]
    articles = sorted((assignment.Article.of(r.asDict(recursive=True)) for r in assignment.ready(spark.createDataFrame(rows, ITEM)).collect()), key=lambda a: (a.at, a.raw_id))
    for compared, candidates in ((3, 1500), (80, 10), (2, 7)):
        monkeypatch.setattr(assignment, "COMPARED", compared)
        monkeypatch.setattr(assignment, "CANDIDATES", candidates)
        recent, got = assignment.Recent(), {}
        for article in articles:
            best = assignment.best_match(article, recent.before(article))
            got[article.raw_id] = (best[0].raw_id, best[1]) if best else (None, 1.0)
            recent.add(article)
        want = plain(rows, compared, candidates)
        assert {i: g[0] for i, g in got.items()} == {i: w[0] for i, w in want.items()}


def test_stream_against_replay(spark, tmp_path):
    """Articles in files, one a batch: state carries over, and stories are those of the replay."""
    rows = sorted(made(120, 3), key=lambda r: (r[4] or r[5], r[0]))
    ready = assignment.ready(spark.createDataFrame(rows, ITEM))
    order = [r["raw_id"] for r in ready.orderBy("at", "raw_id").collect()]
    for k, at in enumerate(range(0, 120, 30)):
        ready.where(F.col("raw_id").isin(order[at : at + 30])).coalesce(1).write.parquet(f"{tmp_path}/in/batch={k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(ready.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/batch=*")
        run = assignment.stories_as_they_come(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = lambda df: sorted(tuple(r) for r in df.select("raw_id", "story", "similarity", "representative").collect())
    assert len(run.recentProgress) >= 4
    assert told(spark.read.parquet(f"{tmp_path}/out")) == told(assignment.assigned(ready))


def test_no_articles(spark):
    assert assignment.assigned(assignment.ready(spark.createDataFrame([], ITEM))).collect() == []


def test_blocks_against_plain_run(spark, monkeypatch):
    """By arrays and blocks, with few candidates and fewer compared, each item joins what it joins one by one."""
    import pyarrow as pa

    rows = [(i, 0, t, s, w, w) for i, (_, _, t, s, _, w) in enumerate(made(90, 2))]
    ready = sorted((r.asDict(recursive=True) for r in assignment.ready(spark.createDataFrame(rows, ITEM)).collect()), key=lambda r: (r["at"], r["raw_id"]))
    for compared, candidates in ((3, 1500), (80, 10), (2, 7), (80, 1500)):
        monkeypatch.setattr(assignment, "COMPARED", compared)
        monkeypatch.setattr(assignment, "CANDIDATES", candidates)
        got = {}
        for block in range(-(-len(ready) // candidates)):
            part = [{"company_id": 0, "block": block, "position": p, "asks": p // candidates == block} | {k: r[k] for k in ("raw_id", "at", "fingerprint", "t", "body", "concepts")} for p, r in enumerate(ready) if block - 1 <= p // candidates <= block]
            for batch in assignment._joined([pa.RecordBatch.from_pylist(part)]):
                got |= {r["raw_id"]: (r["parent"], r["similarity"]) for r in batch.to_pylist()}
        assert got == plain(rows, compared, candidates)


def test_ratios_of_many_items_are_taken_at_once(monkeypatch):
    """A block's items ask for their ratios together, and each only for what can still be its best match."""
    import pyarrow as pa

    from tidewatch.functions.likeness import Titles

    asked, ratios = [], Titles.ratios
    monkeypatch.setattr(Titles, "ratios", lambda self, left, right, least: asked.append(len(left)) or ratios(self, left, right, least))
    draw, concepts = random.Random(5), [{"key": k, "weight": w} for k, _, w in stories.CONCEPTS[:4]]
    rows = [{"company_id": 0, "block": 0, "position": i, "asks": True, "raw_id": i, "at": i, "fingerprint": str(i), "t": " ".join(draw.choices(WORDS, k=6)), "body": " ".join(draw.choices(WORDS, k=9)), "concepts": concepts} for i in range(250)]
    found = [r for b in assignment._joined([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    assert len(found) == 250 and sum(r["parent"] is not None for r in found) > 200
    assert 0 < len(asked) < 50 and sum(asked) < 250 * 249 / 4
