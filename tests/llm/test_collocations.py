import random
import re
from collections import Counter

import pytest

from tidewatch.llm import collocations


def plain(rows, least, first):
    """The contract, stated over plain dictionaries."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    usual = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, words), a in usual.items():
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        inside = any(lang == of and len(long) > len(words) and b >= a and any(long[i : i + len(words)] == words for i in range(len(long))) for (of, long), b in usual.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], n[lang]))
    found, seen = [], Counter()
    for lang, score, a, phrase, left, right, size in sorted(out):
        seen[lang] += 1
        if seen[lang] <= first:
            found.append((lang, seen[lang], phrase.decode(), -a, left, right, size, -score))
    return found


def given(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "YORK", "city", "ß", "Ünder", "x" * 30, " ", "a\x1cb", *"klmnop"]
    texts = []
    for _ in range(150):
        pieces = ["of the new york city" if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(rng.randrange(0, 6))]
        texts.append((rng.choice([". ", ",", "\n", "\r\x0b", "?!", " \t; "]).join(pieces).replace(" ", rng.choice([" ", "\t", "  "])), rng.choice(["en", "fr", None, "und"])))
    return [*texts, *[texts[0]] * 40, (None, "en"), ("", None), (" . \t ", "fr"), ("ha " * 3000, "en")]


@pytest.mark.parametrize("least,first,small", [(3, 40, True), (8, 1000, False), (1, 10, False)])
def test_against_plain(spark, monkeypatch, least, first, small):
    """Every count, cut, rank and drop; batches of a few bytes give the same."""
    if small:
        monkeypatch.setattr(collocations, "SLAB", 200)
        monkeypatch.setattr(collocations, "GATHERED", 100)
    rows = given(least)
    docs = spark.createDataFrame([(t, x, 1) for t, x in rows], "text string, lang string, phrase int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=least, first=first).collect())
    assert got == sorted(plain(rows, least, first)) and got


def test_no_documents(spark):
    for rows in ([], [(None, None)], [("a. b! c", "en")]):
        docs = spark.createDataFrame(rows, "text string, lang string")
        found = collocations.collocations(docs, least=1)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and found.collect() == []


def test_names_with_dots_and_products_beyond_64_bits(spark):
    docs = spark.createDataFrame([("a b", "x")] * 3, "`my.text` string, `my.lang` string")
    assert [tuple(r) for r in collocations.collocations(docs, "my.text", "my.lang", least=2).collect()] == [("x", 1, "a b", 3, 3, 3, 6, 2000)]
    big = 3_000_000_007_000
    counts = spark.createDataFrame([("x", "a b", big, 2), ("x", "a", big + 1, 1), ("x", "b", big + 2, 1)], "lang string, phrase string, m long, words int")
    sizes = spark.createDataFrame([("x", 40 * big)], "lang string, n long")
    assert collocations.scored(counts, sizes).first()["score"] == 1000 * big * 40 * big // ((big + 1) * (big + 2))


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    """Filters far too small for the words rule out less, and results stay the same."""
    monkeypatch.setattr(collocations, "FEWEST_BITS", 6)
    monkeypatch.setattr(collocations, "MOST_BITS", 6)
    rows = given(5)
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(tuple(r) for r in collocations.collocations(docs, least=4, first=50).collect())
    assert got == sorted(plain(rows, 4, 50))
