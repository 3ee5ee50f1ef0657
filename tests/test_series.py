import datetime as dt

import pytest

from tidewatch.functions.scalar import with_robust_z
from tidewatch.streaming import windows


@pytest.mark.parametrize(("value", "history", "z"), [(10.0, [1, 2, 2, 2, 3, 2, 2, 2], 10.0), (2.0, [1, 2, 2, 2, 3, 2, 2, 2], 0.0), (5.0, [1, 2], 0.0), (4.0, [1, 2, 3, 4, 5, 6, 7, 8], -0.5 / (2 * 1.4826))])
def test_robust_z(spark, value, history, z):
    df = spark.createDataFrame([(value, [float(x) for x in history])], "v double, h array<double>")
    assert with_robust_z(df, "v", "h").first()["z"] == pytest.approx(z)


def test_stream_matches_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, start + dt.timedelta(minutes=7 * i), (i % 10) / 10) for i in range(60)]
    df = spark.createDataFrame(rows, "article_id long, company_id long, seen_at timestamp, negative double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = windows.windowed(windows.article_stream(spark, str(tmp_path / "in"), df.schema))
    windows.keep_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = {tuple(r) for r in windows.newest(spark, str(tmp_path / "out")).select("company_id", "window_start", "articles").collect()}
    want = {}
    for _, c, t, _ in rows:
        k = (c, t.replace(minute=t.minute // 15 * 15))
        want[k] = want.get(k, 0) + 1
    assert got == {(*k, n) for k, n in want.items()}
