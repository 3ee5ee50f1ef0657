"""Splits, thresholds, metrics and gates of models, from labels and score columns.

Scores stand in a column; here a document's length against 4,000 characters stands for
a model's score of its quality label. Where scores are ordered, rows are counted by
score first, in thousandths, so that an order has 1,001 rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.series import ORACLE_SQL as SERIES_SQL
from tidewatch.operators.series import drift_shift, feature_windows
from tidewatch.sources.tables import ARTICLES_SQL, articles, table


def scored(spark, sf_dir) -> DataFrame:
    """(doc_id, company_id, y, s): label and score in thousandths."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", (F.col("doc_id") % 12).alias("company_id"), F.col("quality").alias("y"), F.least(F.floor(F.col("n_chars") / 4), F.lit(1000)).cast("long").alias("s"))


_SCORED = "scored AS (SELECT d.doc_id, d.doc_id % 12 AS company_id, quality AS y, CAST(least(floor(n_chars / 4), 1000) AS BIGINT) AS s FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def by_score(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by score with positives and rows at or above it, and those of all."""
    by = rows.groupBy(*keys, "s").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    down = of.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    return by.withColumns({"tp": F.sum("pos").over(down), "taken": F.sum("n").over(down), "all_pos": F.sum("pos").over(of), "all": F.sum("n").over(of)})


def score_metrics(spark, sf_dir):
    """Average precision, Brier score, F2 and macro F1 at one half, in one pass over the
    counts; 0 where a ratio has no base."""
    rows = by_score(scored(spark, sf_dir))
    ap = F.sum(F.col("pos") / F.col("all_pos") * (F.col("tp") / F.col("taken")))
    share = F.col("s") / 1000
    brier = F.sum(F.col("pos") * (1 - share) * (1 - share) + (F.col("n") - F.col("pos")) * share * share) / F.sum("n")
    up = F.col("s") >= 500
    tp, fp = F.sum(F.when(up, F.col("pos")).otherwise(0)), F.sum(F.when(up, F.col("n") - F.col("pos")).otherwise(0))
    fn, tn = F.sum(F.when(~up, F.col("pos")).otherwise(0)), F.sum(F.when(~up, F.col("n") - F.col("pos")).otherwise(0))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    macro = (ratio(2 * tp, 2 * tp + fp + fn) + ratio(2 * tn, 2 * tn + fp + fn)) / 2
    return rows.agg(F.round(ap, 6).alias("average_precision"), F.round(brier, 6).alias("brier"), F.round(ratio(5 * tp, 5 * tp + 4 * fn + fp), 6).alias("f2"), F.round(macro, 6).alias("macro_f1"))


def _grid(rows: DataFrame, low: int, high: int, *keys: str) -> DataFrame:
    """For thresholds from low to high hundredths: true positives, rows taken, totals."""
    cells = rows.withColumn("cell", F.floor(F.col("s") / 10)).groupBy(*keys, "cell").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))  # 101 cells at most
    met = cells.withColumn("t", F.explode(F.sequence(F.lit(low), F.lit(high)).cast("array<long>")))
    up = F.col("cell") >= F.col("t")
    return met.groupBy(*keys, "t").agg(F.sum(F.when(up, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("n")).otherwise(0)).alias("taken"), F.sum("pos").alias("all_pos"), F.sum("n").alias("all"))


def company_thresholds(spark, sf_dir):
    """The threshold of best F2 (the smallest of equals) of each company with ten rows, both
    classes and three positives, by 71 steps from 0.2; and that of best F1 (the largest)."""
    grid = _grid(scored(spark, sf_dir), 20, 90, "company_id").where((F.col("all") >= 10) & (F.col("all_pos") >= 3) & (F.col("all_pos") < F.col("all")))
    f2 = F.coalesce(F.round(5 * F.col("tp") / F.nullif(4 * F.col("all_pos") + F.col("taken"), F.lit(0)), 9), F.lit(0.0))
    f1 = F.coalesce(F.round(2 * F.col("tp") / F.nullif(F.col("all_pos") + F.col("taken"), F.lit(0)), 9), F.lit(0.0))
    best = grid.groupBy("company_id").agg(F.max_by("t", F.struct(f2, -F.col("t"))).alias("f2_at"), F.max_by("t", F.struct(f1, F.col("t"))).alias("f1_at"))
    return best.select("company_id", F.round(F.col("f2_at") / 100, 2).alias("f2_at"), F.round(F.col("f1_at") / 100, 2).alias("f1_at"))


def accept_reject(spark, sf_dir):
    """Bands: accept at most recall with precision of 0.8, reject most rows of which 95 %
    are negative; else the best F1, and 0.2 below it between 0.05 and 0.3."""
    grid = _grid(scored(spark, sf_dir), 5, 95)
    recall, precision = F.col("tp") / F.col("all_pos"), F.col("tp") / F.col("taken")
    f1 = 2 * F.col("tp") / (F.col("all_pos") + F.col("taken"))
    rows = grid.withColumns({"recall": F.round(recall, 9), "precision": F.round(F.when(F.col("taken") > 0, precision).otherwise(0.0), 9), "f1": F.round(f1, 9), "below": F.col("all") - F.col("taken"), "below_pos": F.col("all_pos") - F.col("tp")})
    good = F.col("precision") >= 0.8
    accept = F.coalesce(F.max_by(F.when(good, F.col("t")), F.when(good, F.struct("recall", "precision", "t"))), F.max_by("t", F.struct("f1", "t")))
    chosen = rows.agg(accept.alias("accept"))
    low = rows.join(F.broadcast(chosen), F.col("t") < F.col("accept"), "right")  # one row
    sure = (F.col("below") > 0) & ((F.col("below") - F.col("below_pos")) / F.col("below") >= 0.95)
    picked = low.groupBy("accept").agg(F.max_by(F.when(sure, F.col("t")), F.when(sure, F.struct("below", "t"))).alias("reject"))
    otherwise = F.least(F.lit(30), F.greatest(F.lit(5), F.col("accept") - 20))
    return picked.select(F.round(F.col("accept") / 100, 4).alias("accept"), F.round(F.coalesce("reject", otherwise) / 100, 4).alias("reject"))


def stratified_split(spark, sf_dir):
    """70 / 15 / 15 within each label in order of a hash: rows counted by label, split and
    language. Hash buckets of a label are counted first, so no label is sorted in one task."""
    rows = scored(spark, sf_dir).withColumn("h", F.md5(F.concat(F.lit("41|"), F.col("doc_id").cast("string")))).withColumn("bucket", F.substr("h", F.lit(1), F.lit(2)))
    inside = F.row_number().over(Window.partitionBy("y", "bucket").orderBy("h", "doc_id"))
    counts = rows.groupBy("y", "bucket").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("y")
    before = counts.select("y", "bucket", F.coalesce(F.sum("n").over(of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(of).alias("total"))
    placed = rows.withColumn("at", inside).join(before, ["y", "bucket"]).withColumn("at", F.col("at") + F.col("before") - 1)
    train = F.greatest(F.lit(1), F.floor(F.col("total") * 0.70))
    split = F.when(F.col("at") < train, "train").when(F.col("at") < F.greatest(train + 1, F.floor(F.col("total") * 0.85)), "validation").otherwise("test")
    return placed.select("doc_id", "y", split.alias("split"))


def company_holdout(spark, sf_dir):
    """Companies dealt whole to splits, by the first of 200 hash orders in which every split
    has both labels (else the last). Only companies' label counts are looked at."""
    by = scored(spark, sf_dir).groupBy("company_id").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    tries = by.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(199))))
    of = Window.partitionBy("try")
    order = F.row_number().over(of.orderBy(F.md5(F.concat_ws("|", F.col("try").cast("string"), F.col("company_id").cast("string"))), "company_id"))
    total = F.count(F.lit(1)).over(of)
    held = F.greatest(F.lit(1), F.round(F.col("k") * 0.15))
    tested = F.greatest(F.lit(1), F.col("k") - F.round(F.col("k") * 0.85))
    placed = tries.withColumns({"at": order, "k": total}).withColumn("split", F.when(F.col("at") <= F.col("k") - held - tested, "train").when(F.col("at") <= F.col("k") - tested, "validation").otherwise("test"))
    good = placed.groupBy("try", "split").agg(F.sum("pos").alias("p"), F.sum("n").alias("n")).groupBy("try").agg(F.min((F.col("p") > 0) & (F.col("p") < F.col("n"))).alias("good"))
    first = good.agg(F.coalesce(F.min(F.when(F.col("good"), F.col("try"))), F.max("try")).alias("try"))
    return placed.join(F.broadcast(first), "try").select("company_id", "split")  # one row


def group_folds(spark, sf_dir):
    """Five folds of whole groups, positives spread evenly: groups of each label, largest
    first, are dealt back and forth."""
    rows = articles(spark, sf_dir).groupBy("company_id", "story").agg(F.max((F.col("negative") >= 0.85).cast("int")).alias("y"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("company_id", "y").orderBy(F.desc("n"), "story")
    at = F.row_number().over(order) - 1
    turn, place = F.floor(at / 5), at % 5
    return rows.withColumn("fold", F.when(turn % 2 == 0, place).otherwise(4 - place).cast("long")).groupBy("fold", "y").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"))


def calendar_split(spark, sf_dir):
    """60 / 20 / 20 of the period by the time of a story's first article; stories whose
    articles reach over a border are purged."""
    rows = articles(spark, sf_dir).groupBy("company_id", "story").agg(F.min("seen_at").alias("a"), F.max("seen_at").alias("b"))
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    span = rows.agg(F.min(at("a")).alias("lo"), F.max(at("b")).alias("hi"))
    rows = rows.join(F.broadcast(span), F.lit(True))  # one row
    share = lambda c: (at(c) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    part = lambda c: F.when(share(c) < 0.6, "train").when(share(c) < 0.8, "validation").otherwise("test")
    return rows.select("company_id", "story", F.when(part("a") == part("b"), part("a")).otherwise("purged").alias("split"))


def company_scalers(spark, sf_dir):
    """Median and quartile range of each company's windows (1 for no range) for two
    features, those of all windows for companies with fewer than 90, and the mean of what
    scaling makes of them."""
    rows = feature_windows(articles(spark, sf_dir), "6 hours").select("company_id", F.col("articles").cast("double").alias("articles"), "mean_negative")
    names = ["articles", "mean_negative"]
    ranged = lambda c: F.percentile(c, 0.75) - F.percentile(c, 0.25)
    stats = [f(c).alias(f"{c}_{k}") for c in names for k, f in (("mid", lambda c: F.percentile(c, 0.5)), ("range", ranged))]
    own = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), *stats)
    of_all = rows.agg(*[s.alias(f"all_{c}") for s, c in zip(stats, [f"{c}_{k}" for c in names for k in ("mid", "range")])])
    both = own.join(F.broadcast(of_all), F.lit(True))  # one row
    pick = lambda c: F.when(F.col("n") >= 90, F.col(c)).otherwise(F.col(f"all_{c}"))
    scale = lambda c: F.when(F.abs(pick(f"{c}_range")) < 1e-9, 1.0).otherwise(pick(f"{c}_range"))
    scaler = both.select("company_id", *[x for c in names for x in (pick(f"{c}_mid").alias(f"{c}_mid"), scale(c).alias(f"{c}_range"))])
    return rows.join(scaler, "company_id").groupBy("company_id").agg(*[F.round(F.avg((F.col(c) - F.col(f"{c}_mid")) / F.col(f"{c}_range")), 6).alias(c) for c in names])


def readiness_gates(spark, sf_dir):
    """Tasks and what they lack to be trained: classes below their minimum, and too few new
    labels since the last model."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select(F.explode(F.array(F.struct(F.lit("quality").alias("task"), F.col("quality").alias("y")), F.struct(F.lit("toxic").alias("task"), F.col("toxic").alias("y")))).alias("t"), "doc_id").select("t.*", "doc_id")
    by = rows.groupBy("task").agg(F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative"), F.count_if(F.col("doc_id") >= 800).alias("new"))
    blockers = F.concat_ws(";", F.when(F.col("positive") < 20, F.concat(F.lit("positive "), F.col("positive").cast("string"), F.lit("/20"))), F.when(F.col("negative") < 60, F.concat(F.lit("negative "), F.col("negative").cast("string"), F.lit("/60"))), F.when(F.col("new") < 100, F.concat(F.lit("new "), F.col("new").cast("string"), F.lit("/100"))))
    state = F.when((F.col("positive") < 50) | (F.col("negative") < 150), "provisional").otherwise("production")
    return by.select("task", "positive", "negative", "new", blockers.alias("blockers"), (blockers == "").alias("ready"), state.alias("target_state"))


def promotion_gates(spark, sf_dir):
    """Models by kind of part, their metrics against the minima, and which fail; of those
    that pass, the newest promoted one is in production."""
    minima = {"precision": 0.40, "recall": 0.50, "auc": 0.30}
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model")).agg(F.round(F.avg((F.col("p_size") > 25).cast("double")), 6).alias("precision"), F.round(F.avg((F.col("p_retailprice") > 1000).cast("double")), 6).alias("recall"), F.round(F.avg((F.col("p_partkey") % 3 == 0).cast("double")), 6).alias("auc"), F.max("p_partkey").alias("promoted"))
    failed = F.concat_ws(",", *[F.when(F.coalesce(F.col(k), F.lit(0.0)) < v, F.lit(k)) for k, v in minima.items()])
    rows = rows.withColumn("failed", failed)
    best = F.row_number().over(Window.partitionBy(F.col("failed") == "").orderBy(F.col("promoted").desc_nulls_last(), F.desc("model")))  # one row a model
    return rows.withColumn("at", best).select("model", "failed", ((F.col("failed") == "") & (F.col("at") == 1)).alias("production"))


def readiness_counters(spark, sf_dir):
    """Companies with their articles and usable windows: active from 50 and 40 on."""
    rows = articles(spark, sf_dir)
    windows = feature_windows(rows, "6 hours").groupBy("company_id").agg(F.count_if(F.col("sources") > F.col("failed_sources")).alias("windows"))
    by = rows.groupBy("company_id").agg(F.count(F.lit(1)).alias("articles")).join(windows, "company_id")
    return by.withColumn("ready", (F.col("articles") >= 50) & (F.col("windows") >= 40))


def coverage(spark, sf_dir):
    """Usable six-hour windows of each company against those that its period should have,
    at most 1, and how many are missing."""
    win = feature_windows(articles(spark, sf_dir), "6 hours")
    spine = win.agg(F.min("window_start").alias("lo"), F.max("window_start").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 6 HOURS"))).alias("window_start"))
    companies = win.select("company_id").distinct()
    wanted = companies.crossJoin(F.broadcast(spine))  # a row for each window of the period
    met = wanted.join(win.select("company_id", "window_start", (F.col("sources") > F.col("failed_sources")).alias("usable")), ["company_id", "window_start"], "left")
    by = met.groupBy("company_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("usable")).alias("usable"), F.count_if(F.col("usable").isNull()).alias("missing"))
    return by.withColumn("coverage", F.round(F.least(F.col("usable") / F.col("expected"), F.lit(1.0)), 6))


def company_day_signals(spark, sf_dir):
    """Company days of eight mentions or more: the sum of two ratios, the peak day of the
    company, and the first six different stories."""
    day = F.to_date("seen_at")
    rows = articles(spark, sf_dir).withColumn("day", day)
    first = rows.groupBy("company_id", "day", "story").agg(F.min("article_id").alias("first"))
    six = first.groupBy("company_id", "day").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("first", "story"))), 1, 6), lambda x: x["story"].cast("string")), ",").alias("stories"))
    by = rows.groupBy("company_id", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("negative") >= 0.85).cast("double")) + F.avg((F.col("label") == "negative").cast("double")), 6).alias("signal")).where("n >= 8")
    peak = by.groupBy("company_id").agg(F.max_by("day", F.struct("signal", "day")).alias("peak_day"))
    return by.join(six, ["company_id", "day"]).join(peak, "company_id").select("company_id", "day", "n", "signal", "stories", "peak_day")


def home_ratios(spark, sf_dir):
    """Per day over all companies: the mean of their risk ratios (each at most 1), the pooled
    ratio, and the composition of sentiment with what is not analysed."""
    rows = articles(spark, sf_dir).withColumn("day", F.to_date("seen_at"))
    told = F.when(F.col("article_id") % 7 != 3, F.col("label"))
    by = rows.withColumn("told", told).groupBy("day", "company_id").agg(F.countDistinct("story").alias("stories"), F.count_if(F.col("negative") >= 0.85).alias("risks"), F.count(F.lit(1)).alias("n"), F.count("told").alias("analysed"), F.count_if(F.col("told") == "negative").alias("negative"))
    ratio = F.when(F.col("stories") > 0, F.least(F.lit(1.0), F.col("risks") / F.col("stories")))
    return by.groupBy("day").agg(F.round(F.avg(ratio), 6).alias("mean_ratio"), F.round(F.sum("risks") / F.nullif(F.sum("stories"), F.lit(0)), 6).alias("pooled_ratio"), F.sum("negative").alias("negative"), (F.sum("n") - F.sum("analysed")).alias("unclassified"))


def score_shapes(spark, sf_dir):
    """Scores of windows: logarithm of counts, piecewise calibration on bands, softmax over
    three classes and the three-way label that follows, linear score and blend."""
    rows = feature_windows(articles(spark, sf_dir), "6 hours").select("company_id", "window_start", "articles", "mean_negative", "max_negative")
    m = F.col("mean_negative")
    calibrated = F.when(m <= 0.25, m * 1.2).when(m < 0.65, (m - 0.25) + 0.30).otherwise((m - 0.65) * (0.30 / 0.35) + 0.70)
    parts = {"n": F.exp(m * 2), "u": F.exp(F.lit(1.0)), "p": F.exp((1 - m) * 2)}
    total = parts["n"] + parts["u"] + parts["p"]
    label = F.when((parts["n"] > parts["u"]) & (parts["n"] > parts["p"]), "negative").when((parts["p"] > parts["u"]) & (parts["p"] > parts["n"]), "positive").otherwise("neutral")
    linear = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("max_negative") * 0.7 + F.log1p("articles") * 0.1))
    return rows.select("company_id", "window_start", F.round(F.log1p("articles"), 9).alias("log_articles"), F.round(calibrated, 9).alias("calibrated"), F.round(parts["n"] / total, 9).alias("p_negative"), label.alias("label"), F.round(linear, 9).alias("linear"), F.round(linear * 0.6 + calibrated * 0.4, 9).alias("blended"))


def drift_report(spark, sf_dir):
    """Companies by how many of their features drift, and the farthest."""
    rows = drift_shift(spark, sf_dir)
    return rows.groupBy("company_id").agg(F.count("shift").alias("told"), F.count_if(F.col("drifts")).alias("drifting"), F.max_by("feature", F.struct(F.coalesce("shift", F.lit(-1.0)), "feature")).alias("farthest"))


QUERIES = {f.__name__: f for f in (score_metrics, company_thresholds, accept_reject, stratified_split, company_holdout, group_folds, calendar_split, company_scalers, readiness_gates, promotion_gates, readiness_counters, coverage, company_day_signals, home_ratios, score_shapes, drift_report)}

_WIN = f"{ARTICLES_SQL}, win AS (SELECT company_id, time_bucket(INTERVAL 6 HOURS, seen_at, TIMESTAMP '1970-01-01') AS window_start, count(*) AS articles, avg(negative) AS mean_negative, max(negative) AS max_negative, count(*) FILTER (WHERE source <> 'error') > 0 AS usable FROM articles GROUP BY ALL)"
_GRID = lambda lo, hi: f"g AS (SELECT company_id, t, sum(CASE WHEN s // 10 >= t THEN y ELSE 0 END) AS tp, count(*) FILTER (WHERE s // 10 >= t) AS taken, sum(y) AS all_pos, count(*) AS n FROM scored, range({lo}, {hi + 1}) r(t) GROUP BY ALL)"
ORACLE_SQL = {
    "score_metrics": f"""WITH {_SCORED}, b AS (SELECT s, sum(y) AS pos, count(*) AS n FROM scored GROUP BY s), c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS taken, sum(pos) OVER () AS all_pos FROM b), m AS (SELECT count(*) FILTER (WHERE s >= 500 AND y = 1) AS tp, count(*) FILTER (WHERE s >= 500 AND y = 0) AS fp, count(*) FILTER (WHERE s < 500 AND y = 1) AS fn, count(*) FILTER (WHERE s < 500 AND y = 0) AS tn FROM scored)
      SELECT (SELECT round(sum(pos / all_pos * (tp / taken)), 6) FROM c) AS average_precision, (SELECT round(avg((y - s / 1000) * (y - s / 1000)), 6) FROM scored) AS brier, round(5 * tp / (5 * tp + 4 * fn + fp), 6) AS f2, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1 FROM m""",
    "company_thresholds": f"""WITH {_SCORED}, {_GRID(20, 90)}, f AS (SELECT company_id, t, coalesce(round(5 * tp / nullif(4 * all_pos + taken, 0), 9), 0) AS f2, coalesce(round(2 * tp / nullif(all_pos + taken, 0), 9), 0) AS f1 FROM g WHERE n >= 10 AND all_pos >= 3 AND all_pos < n)
      SELECT company_id, round(max_by(t, f2 * 100000 - t / 1000.0) / 100, 2) AS f2_at, round(max_by(t, f1 * 100000 + t / 1000.0) / 100, 2) AS f1_at FROM f GROUP BY company_id""",
    "accept_reject": f"""WITH {_SCORED}, g AS (SELECT t, sum(CASE WHEN s // 10 >= t THEN y ELSE 0 END) AS tp, count(*) FILTER (WHERE s // 10 >= t) AS taken, sum(y) AS all_pos, count(*) AS n FROM scored, range(5, 96) r(t) GROUP BY t), a AS (SELECT coalesce((SELECT t FROM g WHERE taken > 0 AND round(tp / taken, 9) >= 0.8::DOUBLE ORDER BY round(tp / all_pos, 9) DESC, round(tp / taken, 9) DESC, t DESC LIMIT 1), (SELECT t FROM g ORDER BY round(2 * tp / (all_pos + taken), 9) DESC, t DESC LIMIT 1)) AS accept),
      r AS (SELECT (SELECT t FROM g WHERE t < accept AND n > taken AND ((n - taken) - (all_pos - tp)) / (n - taken) >= 0.95::DOUBLE ORDER BY n - taken DESC, t DESC LIMIT 1) AS reject, accept FROM a) SELECT round(accept / 100, 4) AS accept, round(coalesce(reject, least(30, greatest(5, accept - 20))) / 100, 4) AS reject FROM r""",
    "stratified_split": f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('41|' || doc_id), doc_id) - 1 AS pos, count(*) OVER (PARTITION BY y) AS total FROM scored) SELECT doc_id, y, CASE WHEN pos < greatest(1, floor(total * 0.70::DOUBLE)) THEN 'train' WHEN pos < greatest(greatest(1, floor(total * 0.70::DOUBLE)) + 1, floor(total * 0.85::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM r""",
    "company_holdout": f"""WITH {_SCORED}, b AS (SELECT company_id, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1), t AS (SELECT *, row_number() OVER (PARTITION BY try ORDER BY md5(try || '|' || company_id), company_id) AS place, count(*) OVER (PARTITION BY try) AS k FROM b, range(200) r(try)), p AS (SELECT *, CASE WHEN place <= k - greatest(1, round(k * 0.15::DOUBLE)) - greatest(1, k - round(k * 0.85::DOUBLE)) THEN 'train' WHEN place <= k - greatest(1, k - round(k * 0.85::DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM t),
      g AS (SELECT try, bool_and(good) AS good FROM (SELECT try, split, sum(pos) > 0 AND sum(pos) < sum(n) AS good FROM p GROUP BY ALL) GROUP BY try) SELECT company_id, split FROM p WHERE try = (SELECT coalesce(min(try) FILTER (WHERE good), max(try)) FROM g)""",
    "group_folds": f"""WITH {ARTICLES_SQL}, g AS (SELECT company_id, story, max((negative >= 0.85::DOUBLE)::INT) AS y, count(*) AS n FROM articles GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY company_id, y ORDER BY n DESC, story) - 1 AS place FROM g) SELECT CASE WHEN (place // 5) % 2 = 0 THEN place % 5 ELSE 4 - place % 5 END AS fold, y, count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows FROM r GROUP BY ALL""",
    "calendar_split": f"""WITH {ARTICLES_SQL}, s AS (SELECT company_id, story, floor(epoch(min(seen_at))) AS a, floor(epoch(max(seen_at))) AS b FROM articles GROUP BY ALL), m AS (SELECT min(a) AS lo, max(b) AS hi FROM s), p AS (SELECT company_id, story, CASE WHEN (a - lo) / (hi - lo) < 0.6::DOUBLE THEN 'train' WHEN (a - lo) / (hi - lo) < 0.8::DOUBLE THEN 'validation' ELSE 'test' END AS x, CASE WHEN (b - lo) / (hi - lo) < 0.6::DOUBLE THEN 'train' WHEN (b - lo) / (hi - lo) < 0.8::DOUBLE THEN 'validation' ELSE 'test' END AS z FROM s, m)
      SELECT company_id, story, CASE WHEN x = z THEN x ELSE 'purged' END AS split FROM p""",
    "company_scalers": f"""WITH {_WIN}, w AS (SELECT company_id, articles::DOUBLE AS a, mean_negative AS m FROM win), o AS (SELECT company_id, count(*) AS n, quantile_cont(a, 0.5) AS am, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS ar, quantile_cont(m, 0.5) AS mm, quantile_cont(m, 0.75) - quantile_cont(m, 0.25) AS mr FROM w GROUP BY 1), g AS (SELECT quantile_cont(a, 0.5) AS am, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS ar, quantile_cont(m, 0.5) AS mm, quantile_cont(m, 0.75) - quantile_cont(m, 0.25) AS mr FROM w),
      s AS (SELECT company_id, CASE WHEN n >= 90 THEN o.am ELSE g.am END AS am, CASE WHEN n >= 90 THEN o.ar ELSE g.ar END AS ar, CASE WHEN n >= 90 THEN o.mm ELSE g.mm END AS mm, CASE WHEN n >= 90 THEN o.mr ELSE g.mr END AS mr FROM o, g) SELECT company_id, round(avg((a - am) / CASE WHEN abs(ar) < 1e-9 THEN 1 ELSE ar END), 6) AS articles, round(avg((m - mm) / CASE WHEN abs(mr) < 1e-9 THEN 1 ELSE mr END), 6) AS mean_negative FROM w JOIN s USING (company_id) GROUP BY 1""",
    "readiness_gates": """WITH r AS (SELECT l.doc_id, unnest([{'task': 'quality', 'y': quality}, {'task': 'toxic', 'y': toxic}], recursive := true) FROM documents d JOIN labels l ON l.doc_id = d.doc_id), b AS (SELECT task, count(*) FILTER (WHERE y = 1) AS positive, count(*) FILTER (WHERE y = 0) AS negative, count(*) FILTER (WHERE doc_id >= 800) AS new FROM r GROUP BY task),
      c AS (SELECT *, concat_ws(';', CASE WHEN positive < 20 THEN 'positive ' || positive || '/20' END, CASE WHEN negative < 60 THEN 'negative ' || negative || '/60' END, CASE WHEN new < 100 THEN 'new ' || new || '/100' END) AS blockers FROM b) SELECT *, blockers = '' AS ready, CASE WHEN positive < 50 OR negative < 150 THEN 'provisional' ELSE 'production' END AS target_state FROM c""",
    "promotion_gates": """WITH b AS (SELECT p_brand AS model, round(avg((p_size > 25)::INT), 6) AS p, round(avg((p_retailprice > 1000)::INT), 6) AS r, round(avg((p_partkey % 3 = 0)::INT), 6) AS a, max(p_partkey) AS promoted FROM part GROUP BY 1), f AS (SELECT *, concat_ws(',', CASE WHEN p < 0.40::DOUBLE THEN 'precision' END, CASE WHEN r < 0.50::DOUBLE THEN 'recall' END, CASE WHEN a < 0.30::DOUBLE THEN 'auc' END) AS failed FROM b)
      SELECT model, failed, failed = '' AND row_number() OVER (PARTITION BY failed = '' ORDER BY promoted DESC NULLS LAST, model DESC) = 1 AS production FROM f""",
    "readiness_counters": f"WITH {_WIN}, w AS (SELECT company_id, CAST(sum(articles) AS BIGINT) AS articles, count(*) FILTER (WHERE usable) AS windows FROM win GROUP BY 1) SELECT *, articles >= 50 AND windows >= 40 AS ready FROM w",
    "coverage": f"""WITH {_WIN}, s AS (SELECT unnest(generate_series(min(window_start), max(window_start), INTERVAL 6 HOURS)) AS window_start FROM win), c AS (SELECT DISTINCT company_id FROM win), b AS (SELECT c.company_id, count(*) AS expected, count(*) FILTER (WHERE usable) AS usable, count(*) FILTER (WHERE usable IS NULL) AS missing FROM c CROSS JOIN s LEFT JOIN win w ON w.company_id = c.company_id AND w.window_start = s.window_start GROUP BY 1) SELECT *, round(least(usable / expected, 1.0), 6) AS coverage FROM b""",
    "company_day_signals": f"""WITH {ARTICLES_SQL}, r AS (SELECT *, CAST(seen_at AS DATE) AS day FROM articles), f AS (SELECT company_id, day, story, min(article_id) AS first FROM r GROUP BY ALL), x AS (SELECT company_id, day, array_to_string(list(CAST(story AS VARCHAR) ORDER BY first)[1:6], ',') AS stories FROM f GROUP BY ALL), b AS (SELECT company_id, day, count(*) AS n, round(avg((negative >= 0.85::DOUBLE)::INT) + avg((label = 'negative')::INT), 6) AS signal FROM r GROUP BY ALL HAVING count(*) >= 8)
      SELECT company_id, day, n, signal, stories, first_value(day) OVER (PARTITION BY company_id ORDER BY signal DESC, day DESC) AS peak_day FROM b JOIN x USING (company_id, day)""",
    "home_ratios": f"""WITH {ARTICLES_SQL}, b AS (SELECT CAST(seen_at AS DATE) AS day, company_id, count(DISTINCT story) AS stories, count(*) FILTER (WHERE negative >= 0.85::DOUBLE) AS risks, count(*) AS n, count(*) FILTER (WHERE article_id % 7 <> 3) AS analysed, count(*) FILTER (WHERE article_id % 7 <> 3 AND label = 'negative') AS negative FROM articles GROUP BY ALL)
      SELECT day, round(avg(CASE WHEN stories > 0 THEN least(1.0, risks / stories) END), 6) AS mean_ratio, round(sum(risks) / nullif(sum(stories), 0), 6) AS pooled_ratio, CAST(sum(negative) AS BIGINT) AS negative, CAST(sum(n) - sum(analysed) AS BIGINT) AS unclassified FROM b GROUP BY day""",
    "score_shapes": f"""WITH {_WIN}, s AS (SELECT *, ln(1 + articles) AS la, mean_negative AS m, CASE WHEN mean_negative <= 0.25::DOUBLE THEN mean_negative * 1.2::DOUBLE WHEN mean_negative < 0.65::DOUBLE THEN mean_negative - 0.25::DOUBLE + 0.30::DOUBLE ELSE (mean_negative - 0.65::DOUBLE) * (0.30::DOUBLE / 0.35::DOUBLE) + 0.70::DOUBLE END AS c, exp(mean_negative * 2) AS en, exp(1.0::DOUBLE) AS eu, exp((1 - mean_negative) * 2) AS ep, least(1.0::DOUBLE, greatest(0.0::DOUBLE, max_negative * 0.7::DOUBLE + ln(1 + articles) * 0.1::DOUBLE)) AS l FROM win)
      SELECT company_id, window_start, round(la, 9) AS log_articles, round(c, 9) AS calibrated, round(en / (en + eu + ep), 9) AS p_negative, CASE WHEN en > eu AND en > ep THEN 'negative' WHEN ep > eu AND ep > en THEN 'positive' ELSE 'neutral' END AS label, round(l, 9) AS linear, round(l * 0.6::DOUBLE + c * 0.4::DOUBLE, 9) AS blended FROM s""",
    "drift_report": f"SELECT company_id, count(shift) AS told, count(*) FILTER (WHERE drifts) AS drifting, arg_max(feature, {{'s': coalesce(shift, -1.0), 'f': feature}}) AS farthest FROM ({SERIES_SQL['drift_shift']}) GROUP BY company_id",
}
