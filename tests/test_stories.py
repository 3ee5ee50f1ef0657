"""Matching of pairs against a plain Python statement of the rules."""

import datetime as dt
import difflib
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import stories

ITEM = "raw_id long, company_id long, title string, summary string, published_at timestamp_ntz, collected_at timestamp_ntz"


def plain_match(a, b):
    """Whether two (title, summary, hours) match, as the rules say."""
    text = lambda s: re.sub(r"\s+", " ", s or "").strip().lower()
    tokens = lambda s: {t for t in re.findall("[0-9A-Za-z가-힣]+", s) if len(t) > 1 and t not in stories.STOP_TOKENS}
    joined = lambda s: "".join(re.findall("[0-9A-Za-z가-힣]+", s))
    grams = lambda s: {s} - {""} if len(s) <= 3 else {s[i : i + 3] for i in range(len(s) - 2)}
    cont = lambda x, y: len(x & y) / min(len(x), len(y)) if x and y else 0.0
    jac = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0
    (ta, ba), (tb, bb) = ((text(t), text(s)[: stories.BODY]) for t, s, _ in (a, b))
    hours = abs(a[2] - b[2])
    if hours > stories.FOLLOW_UP or not ta or not tb:
        return False
    if joined(ta) == joined(tb) != "":
        return True
    ratio = difflib.SequenceMatcher(None, joined(ta), joined(tb)).ratio()
    title = max(0.52 * cont(tokens(ta), tokens(tb)) + 0.48 * dice(grams(joined(ta)), grams(joined(tb))), 0.55 * ratio + 0.45 * jac(tokens(ta), tokens(tb)))
    lex = title
    if ba and bb:
        body = max(0.55 * cont(tokens(ba), tokens(bb)) + 0.45 * jac(tokens(ba), tokens(bb)), dice(grams(joined(ba)), grams(joined(bb))))
        lex = min(1, 0.78 * title + 0.22 * body)
    lex = round(lex, 6)
    concepts = lambda t, s: {k: w for k, words, w in stories.CONCEPTS if any(x in f"{t} {s}" for x in words)}
    shared = concepts(ta, ba).keys() & concepts(tb, bb).keys()
    weight = sum(concepts(ta, ba)[k] for k in shared)
    high = sum(k.startswith(("action:", "incident:")) for k in shared)
    if hours > stories.RECENT:
        return lex >= 0.78
    return lex >= 0.66 or (lex >= 0.43 and high >= 1 and weight >= 1.8) or (lex >= 0.30 and high >= 2 and weight >= 3.0)


def test_pairs_against_plain_rules(spark):
    import random

    draw, words = random.Random(1), "thor erin onan plant stops fire crew anea talks union deal queau late again".split()
    at = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        title = " ".join(draw.sample(words, draw.choice([1, 3, 5])))
        summary = draw.choice(["", " ".join(draw.sample(words, 6))])
        when = at + dt.timedelta(hours=draw.choice([0, 5, 100, 160, 400, 800]))
        rows.append((i, 0, title, summary, when if i % 4 else None, when))
    got = {(r["a"], r["b"]) for r in stories.matched_pairs(spark.createDataFrame(rows, ITEM)).collect()}
    fact = [(t, s, (w - at).total_seconds() / 3600) for _, _, t, s, _, w in rows]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if plain_match(fact[a], fact[b])}
    assert want and got == want


@pytest.mark.parametrize(("a", "b", "ratio"), [("abcd", "bcde", 0.75), ("", "", 1.0), ("tide", "diet", 0.5)])
def test_sequence_ratio(spark, a, b, ratio):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(stories.sequence_ratio(F.col("a"), F.col("b"))).first()[0] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())


def made_items(n, spread=(0, 5, 100, 160, 400, 800)):
    import random

    draw, words = random.Random(4), "thor erin onan plant stops fire crew anea talks union deal queau late again".split()
    at = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        when = at + dt.timedelta(hours=draw.choice(spread))
        rows.append((i, i % 2, " ".join(draw.sample(words, draw.choice([1, 3, 5]))), draw.choice(["", " ".join(draw.sample(words, 6))]), when if i % 4 else None, when))
    return rows


def test_pairs_over_several_tiles(spark, monkeypatch):
    """Blocks smaller than a company change no pair; without scores fewer pairs link the same items."""
    rows = spark.createDataFrame(made_items(80), ITEM)
    told = lambda df: sorted(tuple(r) for r in df.collect())
    want = told(stories.matched_pairs(rows))
    monkeypatch.setattr(stories, "TILE", 7)
    assert want and told(stories.matched_pairs(rows)) == want
    links = stories.matched_pairs(rows, scored=False)
    ends = lambda df: told(stories.components(df.select("a", "b")))
    assert links.columns == ["a", "b"] and links.count() < len(want)
    assert ends(links) == ends(spark.createDataFrame(want, "a long, b long, score double"))


def test_no_pair_carries_its_texts(spark):
    """Only items travel, so what is shuffled does not grow with the pairs that share a word."""
    plan = stories.matched_pairs(spark.createDataFrame(made_items(10), ITEM))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "explode" not in plan


def test_ratio_of_strings_is_difflibs():
    import random

    from tidewatch.functions.likeness import sequence_ratio

    draw = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(draw.choices("abcde"[: draw.choice([2, 5])], k=draw.choice([0, 1, 7, 40, 210]))) for _ in "ab")
        assert sequence_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()


def test_ratios_of_many_pairs_are_difflibs():
    """All at once, with popular characters and without; where less than `least` is enough, less than that."""
    import random

    import numpy as np

    from tidewatch.functions.likeness import Texts

    draw = random.Random(3)
    texts = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz가나"[: draw.choice([2, 5, 28])], k=draw.choice([0, 1, 7, 40, 199, 200, 450]))) for _ in range(25)]
    texts += [t[:k] + draw.choice("az") + t[k + 3 :] for t, k in ((draw.choice(texts), draw.choice([0, 30, 150])) for _ in range(25))]
    left, right = (x.ravel() for x in np.meshgrid(np.arange(50), np.arange(50)))
    want = np.array([difflib.SequenceMatcher(None, texts[a], texts[b]).ratio() for a, b in zip(left, right)])
    assert (Texts(texts).ratios(left, right, np.full(len(left), -1.0)) == want).all()
    least = np.random.default_rng(1).random(len(left))
    found = Texts(texts).ratios(left, right, least)
    assert ((found == want) | ((want < least) & (found < least))).all()


def test_linked_items_are_not_compared_again(monkeypatch):
    """Of items that are linked already no sequence ratio is taken when only links are asked for."""
    import pyarrow as pa

    from tidewatch.functions.likeness import Titles

    asked, ratios = [], Titles.ratios
    monkeypatch.setattr(Titles, "ratios", lambda self, left, right, least: asked.append(len(left)) or ratios(self, left, right, least))
    concepts = [{"key": k, "weight": w} for k, _, w in stories.CONCEPTS[:2]] + [{"key": "object:site", "weight": 0.7}]
    words = "plant stops after fire while crew talks with union about the deal again".split()
    rows = [{"company_id": 0, "i": 0, "j": 0, "own": False, "raw_id": i, "at": 0, "t": " ".join(words[i % 7 : i % 7 + 6]), "body": f"{i} erin", "concepts": concepts} for i in range(300)]
    told = lambda scored: [r for b in stories._pairs_of_tiles([pa.RecordBatch.from_pylist(rows)], scored) for r in b.to_pylist()]
    pairs, all_asked = told(True), sum(asked)
    asked.clear()
    links = told(False)
    assert len(links) == 299 and len(pairs) > 10_000
    assert sum(asked) < all_asked / 100
