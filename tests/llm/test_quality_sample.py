"""The classifier learns from whole texts."""

import pytest

from tidewatch.llm import quality


@pytest.mark.parametrize("most", [12_000_000, 100 * 512])
def test_all_chunks_of_a_sampled_text(spark, monkeypatch, most):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, prior: seen.extend(rows))
    monkeypatch.setattr(quality, "SAMPLE_BYTES", most)
    texts = {i: "".join(f"{i} {n} " for n in range(3_000)) for i in range(6)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    quality.learn(docs, spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int"))
    whole = {quality.chunked(t.encode()).tobytes() for t in texts.values()}
    assert {x for x, _ in seen} <= whole and all(sum(len(x) for x, y in seen if y == label) <= most for label in (0, 1))
    assert len(seen) >= 2


def test_a_huge_text_leaves_its_class_the_others(spark, monkeypatch):
    """A text above the bound, wherever it stands in the order, drops no other; ids may be text."""
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda rows, prior: seen.update(n=[y for _, y in rows], sizes=[len(x) for x, _ in rows]) or {})
    rows = [(f"d{i}", ("good " if i % 2 else "bad ") * 40, i % 2) for i in range(40)] + [("huge", "x" * 13_000_000, 1), ("long", "y" * 700_000, 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, quality int").repartition(4)
    monkeypatch.setattr(quality, "held_out", lambda c: c.isNull())
    quality.learn(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert seen["n"].count(0) == 20 and seen["n"].count(1) == 21 and max(seen["sizes"]) < 1_000_000
