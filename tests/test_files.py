import json

import pytest

from tidewatch.sources import files


def test_csv_with_a_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿event,is_risk,note\n1, true ,"a, ""b"""\n2,FALSE,\n3,maybe,x\n', "utf-8")
    got = files.labels_csv(spark, str(tmp_path / "a.csv"), "is_risk", ["TRUE", "FALSE"]).collect()
    assert [(r["event"], r["is_risk"], r["note"]) for r in got] == [("1", "TRUE", 'a, "b"'), ("2", "FALSE", None)]


def test_json_lines_torn_at_the_end(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": "a"}\n\n{"id": 2, "x": "b"}\n{"id": 3, "x')
    rows = files.json_lines(spark, str(tmp_path / "a.jsonl"), "id long, x string")
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, "b")]
    (tmp_path / "b.jsonl").write_text('{"id": 1, "x": "a"}\n{"id": 2, "x\n{"id": 3, "x": "c"}\n')
    with pytest.raises(Exception, match="broken line"):
        files.json_lines(spark, str(tmp_path / "b.jsonl"), "id long, x string").collect()
    (tmp_path / "c.jsonl").write_text("")
    assert files.json_lines(spark, str(tmp_path / "c.jsonl"), "id long, x string").collect() == []


def test_nested_document(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"types": {"R01": {"items": [{"id": "a", "verified": True, "hours": 3}, {"id": "b"}]}, "R02": {"items": []}}}, indent=1))
    got = sorted(tuple(r) for r in files.nested_map(spark, str(tmp_path / "d.json")).collect() if r["id"])
    assert got == [("R01", "a", True, 3), ("R01", "b", None, None)]


def test_reports_and_backups(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', None), (2, "c", 0.5)], "id long, name string, p double")
    for form in ("csv", "json"):
        files.write_report(df, str(tmp_path / form), form)
        files.write_report(df, str(tmp_path / form), form)
    assert sorted(r["name"] for r in spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()) == ['a,"b"', "c"]
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    files.back_up(df, str(tmp_path / "backup"))
    assert sorted(json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "backup")).collect()) == [1, 2]
    with pytest.raises(Exception, match="exists"):
        files.back_up(df, str(tmp_path / "backup"))


@pytest.mark.parametrize("n", [0, 1, 119, 800, 919, 920, 1620, 5000])
def test_chunks_cover_the_text(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = [r["text"] for r in sorted(files.chunks(spark.createDataFrame([(1, 1, text), (2, 1, None)], "doc_id long, page int, text string")).collect(), key=lambda r: r["chunk"])]
    assert "".join(got[:1] + [c[100:] for c in got[1:]]) == text
    assert all(len(c) == 800 for c in got[:-1]) and (len(got) < 2 or 220 <= len(got[-1]) < 920)


def test_vector_store(spark, tmp_path):
    assert files.load_vectors(spark, str(tmp_path / "none")) is None
    files.save_vectors(spark.createDataFrame([(1, [0.5, 1.0])], "id long, vector array<float>"), str(tmp_path / "v"))
    assert files.load_vectors(spark, str(tmp_path / "v")).first()["vector"] == [0.5, 1.0]


def test_merge(spark):
    stored = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 5)], "id long, name string, hits int")
    changes = spark.createDataFrame([(2, "B"), (3, "c"), (None, "N")], "id long, name string")
    got = sorted(map(tuple, files.merged(stored, changes, ["id"]).collect()), key=str)
    assert got == [(1, "a", 10), (2, "B", 20), (3, "c", None), (None, "N", 5)]
