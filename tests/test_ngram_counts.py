"""N-grams counted as numbers, against the plain count."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.operators import spectra

HAN = "".join(chr(0x4E00 + i) for i in range(300))
TEXTS = ["abab abab", "abab", None, "", "x", "a\0b\0\0", "ünü ünü", "😀x😀x😀", "abab", HAN, HAN[:60] * 3, HAN[200:] + "\U0001f600" * 9]


def counted(texts, size=3):
    found, seen = Counter(), Counter()
    batches = (pa.RecordBatch.from_arrays([pa.array(range(len(texts[i : i + size]))), pa.array(texts[i : i + size], pa.string())], names=["id", "text"]) for i in range(0, len(texts), size))
    for batch in spectra._counted(batches):
        for term, of, n in zip(*(c.to_pylist() for c in batch.columns)):
            seen[term] += of
            found[term] += n
    return seen, found


@pytest.mark.parametrize("limits", [{}, {"HELD": 50, "WAITING": 20}, {"MOST_CHARACTERS": 250}, {"HELD": 9, "WAITING": 0, "MOST_CHARACTERS": 40}])
def test_counts_whatever_is_held(monkeypatch, limits):
    """Counts are sent on early, characters are numbered anew, a text has too many of them."""
    seen, found = Counter(), Counter()
    for text in TEXTS:
        own = spectra.grams(text or "")
        seen.update(own.keys())
        found.update(own)
    for name, value in limits.items():
        monkeypatch.setattr(spectra, name, value)
    assert counted(TEXTS) == (seen, found) and counted([]) == (Counter(), Counter())


def test_no_python_object_an_ngram(monkeypatch):
    monkeypatch.setattr(spectra, "grams", None)
    assert counted(["abab", "ab"])[1]["ab"] == 3


def test_weights_whatever_the_characters(spark):
    """Terms by number and by text give the same rows; characters of no term make no n-gram of others."""
    df = spark.createDataFrame(list(enumerate([*TEXTS, "a?b", "ab?ab"])), "id long, text string").coalesce(1)
    terms = {t: (i, 1 + i / 7) for i, t in enumerate(["ab", "aba", "ba", "abab", "ün", "😀x", HAN[5:8], "\0\0"])}
    many = terms | {chr(0x10000 + 2 * i) + chr(0x10001 + 2 * i): (len(terms) + i, 1.0) for i in range(33_000)}
    by_number, by_text = ({r["id"]: r for r in spectra.tfidf(df, t).collect()} for t in (terms, many))
    assert by_number.keys() == by_text.keys() and len(by_number) == len(TEXTS) + 2
    assert by_number[5]["at"] == [7] and by_number[12]["at"] == [] and by_number[13]["at"] == [0]
    for i, row in by_number.items():
        assert row["at"] == by_text[i]["at"] and np.allclose(row["weight"], by_text[i]["weight"], rtol=1e-12)


def test_rounds_read_bytes_and_the_image_is_kept(spark, monkeypatch):
    """Rows are read once a round and once for the image, which is multiplied with nothing but
    what is small; they are bytes, not arrays."""
    seen, plain = [], spectra.written
    monkeypatch.setattr(spectra, "written", lambda df: seen.append(df.schema.simpleString()) or plain(df))
    df = spark.createDataFrame([(i, f"text {i} of many {i % 3}") for i in range(40)], "id long, text string")
    got = spectra.text_features(df).collect()
    assert len(got) == 40 and {len(r["features"]) for r in got} == {32}
    assert seen[1:] == ["struct<id:bigint,at:binary,weight:binary>", "struct<id:bigint,features:array<double>>"]
