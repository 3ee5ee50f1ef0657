"""The broadcast table of token counts is bounded in bytes, and copies do not fill its sample."""

from tidewatch.llm import token_counts
from tidewatch.llm.vocabulary import default_path, vocabulary


def test_long_pre_tokens_stay_out_and_count_all_the_same(spark):
    huge, wide = "x" * 100_000, "é" * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate([f"{huge} {huge} one", f"{wide} one two", None, "", "one " * 50])], "id int, text string")
    table = token_counts.frequent_pre_tokens(df, "text", default_path())
    assert table and max(len(w.encode()) for w in table) <= token_counts.ENTRY_BYTES
    got = {r["id"]: r["n_tokens"] for r in token_counts.count_tokens(df).collect()}
    library = vocabulary(default_path()).library
    assert got == {r["id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in df.collect()}


def test_copies_count_once_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SAMPLE_TEXTS", 10_000)
    df = spark.createDataFrame([("copied words",)] * 500 + [("rare",), ("rare again",)], "text string")
    assert list(token_counts.frequent_pre_tokens(df, "text", default_path(), entries=1)) == ["rare"]
