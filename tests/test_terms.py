"""Terms in texts against a plain search with regular expressions."""

import random
import re

import pytest

from tidewatch.functions.terms import prepared_terms, texts_holding


def plain(text, term):
    if re.fullmatch(r"[a-z0-9 .&+-]+", term):
        return re.search(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])", text) is not None
    return term in text


TERMS = ["two words", "Two  Words again", "c++", "a.b", "서울", "서울 시청", "r&d", "ü", "über uns", "x", "", None, "co", "co.", "日本", "aaa", "aa"]
TEXTS = ["here are two words again", "twotwo words", "c++ and c+++ and c", "a.b axb", "서울시청 앞", "서울 시청앞", "r&d r&dx", "über unser", "(co.) coco co.x", "日本語", "aaaa aaa", "", None, "two words two words"]


@pytest.mark.parametrize("most_bytes", [1 << 20, 40, 1])
def test_against_plain(spark, most_bytes):
    """Words, signs, Hangul, terms within terms; one group of terms or many."""
    draw = random.Random(5)
    texts = TEXTS + [" ".join(draw.choices("two words again co a.b aa aaa 서울 시청 x r&d".split(), k=7)) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    terms = prepared_terms(spark.createDataFrame([(t,) for t in TERMS * 2], "term string"))
    usual = sorted(r["term"] for r in terms.collect())
    assert "two words again" in usual and "x" not in usual and len(usual) == len(set(usual))
    got = sorted((r["id"], r["term"]) for r in texts_holding(rows, terms, most_bytes).collect())
    assert got == sorted((i, t) for i, text in enumerate(texts) for t in usual if text and plain(text, t)) and got


def test_nothing_to_find(spark):
    none = prepared_terms(spark.createDataFrame([], "term string"))
    rows = spark.createDataFrame([("a", "text")], "id string, norm string")
    assert texts_holding(rows, none).collect() == []
    some = prepared_terms(spark.createDataFrame([("text",)], "term string"))
    assert texts_holding(rows.limit(0), some).collect() == [] and [tuple(r) for r in texts_holding(rows, some).collect()] == [("a", "text")]
