"""Character n-gram features against dense algebra."""

import math
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from tidewatch.operators import spectra


def plain_matrix(texts, most):
    """The whole TF-IDF matrix, term by term."""
    counts = [Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)) for t in texts]
    seen, often = Counter(), Counter()
    for c in counts:
        seen.update(c.keys())
        often.update(c)
    terms = sorted((t for t in often if seen[t] >= spectra.LEAST_TEXTS), key=lambda t: (-often[t], t.encode()))[:most]
    at = {t: i for i, t in enumerate(terms)}
    a = np.zeros((len(texts), len(terms)))
    for row, c in enumerate(counts):
        for t, n in c.items():
            if t in at:
                a[row, at[t]] = (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + seen[t])) + 1)
    norms = np.sqrt((a * a).sum(1, keepdims=True))
    return a / np.where(norms == 0, 1, norms)


@pytest.mark.parametrize("most", [500, 18_000])
def test_features_against_whole_svd(spark, most):
    """Sizes of directions, and the texts' distances along them, are those of numpy's SVD. Where
    sizes are near each other, in the tail, five rounds come within three per cent."""
    rows = spectra._texts(spark, SF).orderBy("id").collect()
    texts = [r["text"] for r in rows]
    got = {r["id"]: r["features"] for r in spectra.text_features(spectra._texts(spark, SF).repartition(5), most=most).collect()}
    found = np.array([got[r["id"]] for r in rows])
    a = plain_matrix(texts, most)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert found.shape == (len(texts), spectra.COMPONENTS)
    sizes = np.sqrt((found**2).sum(0))
    assert np.allclose(sizes, s[: spectra.COMPONENTS], rtol=0.03) and np.allclose(sizes[:8], s[:8], rtol=1e-4)
    whole, part = u[:, :8] * s[:8], found[:, :8]
    assert np.allclose(np.abs((whole * part).sum(0)), s[:8] ** 2, rtol=1e-3)
    left, _ = np.linalg.qr(found)
    cosines = np.linalg.svd(u[:, :12].T @ left)[1]
    assert cosines.min() > 0.99


def test_matrix_rows(spark):
    """Places and weights; texts that are null, empty or repeated."""
    texts = ["abab abab", "abab", "ababa", None, "", "x", "abab", "ünü"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = spectra.vocabulary(df, most=4)
    assert [(r["term"], r["texts"], r["n"]) for r in found.collect()] == [("ab", 4, 10), ("aba", 4, 6), ("ba", 4, 6), ("abab", 4, 5)]
    terms = {r["term"]: (i, 1.5) for i, r in enumerate(found.collect())}
    rows = {r["id"]: r for r in spectra.tfidf(df, terms).collect()}
    assert len(rows) == 8 and rows[3]["at"] == rows[4]["at"] == rows[5]["at"] == rows[7]["at"] == []
    assert rows[1]["at"] == rows[6]["at"] and rows[1]["weight"] == rows[6]["weight"]
    assert sum(w * w for w in rows[0]["weight"]) == pytest.approx(1)


def test_little_to_learn(spark):
    for rows in ([], [(1, "abc")], [(1, None), (2, ""), (3, "a")]):
        got = spectra.text_features(spark.createDataFrame(rows, "id long, text string")).collect()
        assert [r["features"] for r in got] == [[]] * len(rows)
    same = [(i, "all the same text") for i in range(9)]
    got = np.array([r["features"] for r in spectra.text_features(spark.createDataFrame(same, "id long, text string")).collect()])
    assert np.allclose(np.abs(got[:, 0]), 1) and np.allclose(got[:, 1:], 0, atol=1e-6)


def test_packed_rows_are_the_rows_in_few_bytes(spark):
    """Gaps and counts of any size come back as the same weights, in about two bytes an n-gram."""
    values = np.array([0, 1, 254, 255, 256, 509, 510, 511, 18_000, 0, 70_000])
    rows, found = spectra._unpacked([spectra._packed(values), b"", spectra._packed(values[::-1])])
    assert found.tolist() == [*values, *values[::-1]] and rows.tolist() == [0] * 11 + [2] * 11
    df = spark.createDataFrame([(i, "ab" * 300 * (i == 2) + f"text {i} of many {i % 3}" * (i % 5)) for i in range(40)], "id long, text string").coalesce(1)
    terms = {r["term"]: (i * 7, 1 + i / 9) for i, r in enumerate(spectra.vocabulary(df, most=400).collect())}
    plain, packed = spectra.tfidf(df, terms).toArrow(), spectra.tfidf(df, terms, packed=True).toArrow()
    rarity = np.ones(7 * len(terms))
    rarity[::7] = [r for _, r in terms.values()]
    dense = np.concatenate([d for b in packed.to_batches() for d in spectra._dense(b, rarity)])
    want = np.zeros(dense.shape)
    for row, (at, weight) in enumerate(zip(plain["at"].to_pylist(), plain["weight"].to_pylist())):
        want[row, at] = weight
    n = sum(len(x) for x in plain["at"].to_pylist())
    assert n > 500 and np.allclose(dense, want, rtol=1e-12)
    assert sum(len(x) for name in ("at", "weight") for x in packed[name].to_pylist()) < 2.2 * n
