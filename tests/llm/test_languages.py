import unicodedata
from collections import Counter

import numpy as np
from conftest import SF

from tidewatch.llm import languages


def plain_ngrams(text):
    """All n-grams of one text as strings, with ' ' for every limit of a word."""
    text = "".join(c if c.isalpha() or unicodedata.category(c)[0] == "M" else " " for c in f" {text.lower()} ")
    found = Counter()
    for n in range(1, languages.LONGEST + 1):
        for at in range(len(text) - n + 1):
            gram = text[at : at + n]
            if gram.strip() and " " not in gram[1:-1]:
                found[gram] += 1
    return found


def test_ngrams_against_plain(monkeypatch):
    """As many n-grams, equal ones with equal hashes, however texts fall into slabs."""
    texts = ["Ab, ça! 12 x", "", "é" * 50, "one two  three", "İstanbul ß नमस्ते", "abc" * 40]
    want = [plain_ngrams(t) for t in texts]
    for slab in (7, 64, 1 << 16):
        monkeypatch.setattr(languages, "SLAB", slab)
        got = [Counter() for _ in texts]
        for hashes, owners, _ in languages.ngrams(texts):
            for h, i in zip(hashes.tolist(), owners.tolist()):
                got[i][h] += 1
        for g, w in zip(got, want):
            assert sorted(g.values()) == sorted(w.values())


def test_filters_against_sets(spark):
    """The bits of all languages hold every usual n-gram, and decisions are those of
    plain sets."""
    rows = [(i, {"xx": "uno dos tres cuatro", "yy": "one two three four", "zz": "eins zwei drei vier"}[lang] + f" {'abcdefgh'[i % 8]}q", lang) for i in range(60) for lang in ("xx", "yy", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.learn(docs)
    assert model["langs"] == ["xx", "yy", "zz"]
    import zlib

    sets = {}
    for lang in model["langs"]:
        count = Counter()
        for i, text, of in rows:
            if of == lang and zlib.crc32(str(i).encode()) % 3 != 1:
                count.update(plain_ngrams(text))
        total = sum(count.values())
        sets[lang] = {g for g, n in count.items() if n * languages.USUAL >= total}
    texts = ["two three one", "tres dos", "drei eins und one", "zwei vier zwei"]
    for text in texts:
        grams = plain_ngrams(text)
        held = np.zeros(3)
        for hashes, _, _ in languages.ngrams([text]):
            found = languages.answers(model["filters"], hashes)[0]
            held += [int(((found >> np.uint64(i)) & np.uint64(1)).sum()) for i in range(3)]
        exact = np.array([sum(n for g, n in grams.items() if g in sets[x]) for x in model["langs"]])
        assert (held >= exact).all() and (held - exact <= 1).all()
        assert languages.decide(model, [text])[0][0] == model["langs"][int(exact.argmax())]


def test_held_out_accuracy(spark):
    """Nine tenths and more on the few rows of sf0.001; a text counts by itself alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = languages.op11_language_id(spark, SF).join(docs, "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(got) > 40 and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert languages.op11_language_id(spark, SF).count() == docs.count()


def test_odd_documents(spark):
    """Nulls, no letters, unknown letters, repeated rows, clashing and dotted names, text ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.learn(docs.unionByName(docs.selectExpr("doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS lang", "source", "n_chars")))
    rows = [("a", None, 1.0), ("a", "", 2.0), (None, "12 !! \n 7", 3.0), ("b", "日本", 4.0), ("c", "The and of this with. " * 9000, 5.0), ("c", "The and of this with. " * 9000, 5.0)]
    df = spark.createDataFrame(rows, "`a.b` string, text string, score double")
    got = languages.identify(df, model)
    assert got.columns == ["a.b", "text", "lang_pred", "score"]
    found = [(r[0], r["lang_pred"], r["score"]) for r in got.collect()]
    assert found[:3] == [("a", "und", 0.0), ("a", "und", 0.0), (None, "und", 0.0)]
    assert found[3][1] in model["langs"] and found[3][2] == 0.0
    assert found[4] == found[5] and found[4][1] == "en"
    assert languages.identify(df.limit(0), model).collect() == []
    none = languages.learn(docs.limit(0))
    assert none["langs"] == [] and {r["lang_pred"] for r in languages.identify(df, none).collect()} == {"und"}
    text_ids = languages.learn(docs.selectExpr("concat('id', doc_id) AS doc_id", "text", "lang"))
    assert text_ids["langs"] == model["langs"]


def test_more_languages_than_bits_of_a_word(spark):
    """Seventy languages take two words of bits."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: letters[k % 26] * 3 + letters[k // 26] * 3
    rows = [(i, f"{word(k)} {word(k)}", f"l{k:02d}") for k in range(70) for i in range(6)]
    model = languages.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model["filters"].shape[0] == 2 and len(model["langs"]) == 70
    got = languages.decide(model, [word(k) for k in range(70)])
    assert [g[0] for g in got] == [f"l{k:02d}" for k in range(70)]
