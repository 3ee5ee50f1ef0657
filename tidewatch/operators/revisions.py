"""Evidence of story events over several runs, and how often it was revised.

A run replaces an event's evidence by what is related now. Each link that came, went, or whose
score moved, raises the event's revision by one; a response answers the revision of its time.
Links and counters are tables in versions, one version a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.sources.scratch import shared_folder
from tidewatch.sources.tables import ARTICLES_SQL, articles
from tidewatch.sources.versions import Versions, changes

#: Weights of a link's score, what a score must move by, and an official source (fixed values).
WEIGHTS = {"risk": 0.30, "relevance": 0.25, "type_match": 0.20, "credibility": 0.15, "representativeness": 0.10}
LEAST_MOVE, OFFICIAL = 0.05, 0.90
#: The ends of the runs that the queries make.
RUNS = ("2024-01-12", "2024-01-16", "2024-01-22")
LINKS = "company_id long, story long, article_id long, score double, credibility double"
COUNTERS = "company_id long, story long, revision long, answered long"
CHANGES = "company_id long, story long, added long, removed long, revised long, new_official boolean, revision long, answered long"


def evidence_score(columns: dict[str, Column]) -> Column:
    """The weighted score of a link, between 0 and 1."""
    total = sum((F.least(F.greatest(columns[k], F.lit(0.0)), F.lit(1.0)) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.round(F.least(total, F.lit(1.0)), 6)


def run(links: Versions, counters: Versions, told: Versions, version: int, current: DataFrame, answers: Column) -> DataFrame:
    """Make one run: `current`, rows of LINKS without null ids, replaces the links of the version before; the
    counters of events follow. `answers`, over a counter's columns, tells the events that get a
    response in this run. Gives the run's changes, a row of each event that was ever seen."""
    now = links.write(current, version)
    feed = changes(links.read(version - 1), now, ["company_id", "story", "article_id"], "score", LEAST_MOVE)
    official = now.where(F.col("credibility") >= OFFICIAL).select("company_id", "story", "article_id", F.lit(True).alias("official"))
    feed = feed.join(official, ["company_id", "story", "article_id"], "left")
    delta = feed.groupBy("company_id", "story").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "revised")], F.bool_or((F.col("change") == "added") & F.coalesce("official", F.lit(False))).alias("new_official"))
    seen = counters.read(version - 1).join(delta, ["company_id", "story"], "full").na.fill({"revision": 0, "answered": 0, "added": 0, "removed": 0, "revised": 0, "new_official": False})
    seen = seen.withColumn("revision", F.col("revision") + F.col("added") + F.col("removed") + F.col("revised"))
    seen = seen.withColumn("answered", F.when(answers, F.col("revision")).otherwise(F.col("answered")))
    out = told.write(seen.select("company_id", "story", "added", "removed", "revised", "new_official", "revision", "answered"), version)
    counters.write(out.select("company_id", "story", "revision", "answered"), version)
    return out


def _links(spark, sf_dir, number: int, end: str) -> DataFrame:
    """The links of a run: articles seen by its end, but for some that it no longer accepts."""
    rows = articles(spark, sf_dir).where((F.col("created_at") < F.lit(end).cast("timestamp_ntz")) & F.col("story").isNotNull() & ((F.col("article_id") + number) % 11 != 0))
    first = rows.groupBy("company_id", "story").agg(F.min("article_id").alias("first"))
    rows = rows.join(first, ["company_id", "story"])
    credibility = F.when(F.col("source") == "purchase", 0.9).when(F.col("source") == "click", 0.7).otherwise(0.5)
    columns = {
        "risk": F.coalesce("negative", F.lit(0.0)), "relevance": F.coalesce("negative", F.lit(0.0)) + F.col("article_id") % 5 * (0.06 * number), "type_match": F.col("article_id") % 3 * 0.5,
        "credibility": credibility, "representativeness": F.when(F.col("article_id") == F.col("first"), 1.0).otherwise(0.5),
    }
    return rows.select("company_id", "story", "article_id", evidence_score(columns).alias("score"), credibility.alias("credibility"))


def evidence_revisions(spark, sf_dir):
    """Three runs in a row: of each event and run the links that came, went and moved, whether a
    new one is official, the revision, and whether it waits for a response."""
    folder = shared_folder(spark)
    links, counters, told = (Versions(spark, f"{folder}/{n}", s) for n, s in (("links", LINKS), ("counters", COUNTERS), ("changes", CHANGES)))
    out = None
    for number, end in enumerate(RUNS, 1):
        answers = (F.col("company_id") + number) % 2 == 0
        one = run(links, counters, told, number, _links(spark, sf_dir, number, end), answers).select(F.lit(number).alias("run"), "*", (F.col("revision") > F.col("answered")).alias("waiting"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"evidence_revisions": evidence_revisions}


def _links_sql(number: int, end: str) -> str:
    clamp = lambda x: f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"
    values = {"risk": "coalesce(negative, 0.0::DOUBLE)", "relevance": f"coalesce(negative, 0.0::DOUBLE) + article_id % 5 * ({0.06 * number!r}::DOUBLE)", "type_match": "article_id % 3 * 0.5::DOUBLE", "credibility": "credibility", "representativeness": "CASE WHEN article_id = min(article_id) OVER (PARTITION BY company_id, story) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END"}
    score = " + ".join(["0.0::DOUBLE", *(f"{clamp(values[k])} * {w!r}::DOUBLE" for k, w in WEIGHTS.items())])
    return f"""l{number} AS (SELECT company_id, story, article_id, credibility, round(least({score}, 1.0::DOUBLE), 6) AS score
      FROM (SELECT *, CASE WHEN source = 'purchase' THEN 0.9::DOUBLE WHEN source = 'click' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS credibility FROM articles WHERE created_at < TIMESTAMP '{end}' AND story IS NOT NULL AND (article_id + {number}) % 11 <> 0))"""


def _delta_sql(number: int) -> str:
    before = f"l{number - 1}" if number > 1 else "(SELECT * FROM l1 WHERE false)"
    return f"""d{number} AS (SELECT {number} AS run, coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.story, b.story) AS story, count(*) FILTER (WHERE b.article_id IS NULL) AS added, count(*) FILTER (WHERE a.article_id IS NULL) AS removed,
      count(*) FILTER (WHERE abs(a.score - b.score) >= {LEAST_MOVE}::DOUBLE) AS revised, coalesce(bool_or(b.article_id IS NULL AND a.credibility >= {OFFICIAL}::DOUBLE), false) AS new_official FROM l{number} a FULL JOIN {before} b USING (company_id, story, article_id) GROUP BY ALL)"""


_N = range(1, len(RUNS) + 1)
ORACLE_SQL = {
    "evidence_revisions": f"""WITH {ARTICLES_SQL}, {', '.join(_links_sql(n, RUNS[n - 1]) for n in _N)}, {', '.join(_delta_sql(n) for n in _N)}, d AS ({' UNION ALL '.join(f'SELECT * FROM d{n}' for n in _N)}),
      e AS (SELECT company_id, story, min(run) AS began FROM d GROUP BY ALL), f AS (SELECT r.run, e.company_id, e.story, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(revised, 0) AS revised, coalesce(new_official, false) AS new_official
        FROM e JOIN (SELECT CAST(unnest(range(1, {len(RUNS) + 1})) AS INT) AS run) r ON r.run >= began LEFT JOIN d ON d.run = r.run AND d.company_id = e.company_id AND d.story = e.story),
      g AS (SELECT *, CAST(sum(added + removed + revised) OVER (PARTITION BY company_id, story ORDER BY run) AS BIGINT) AS revision FROM f),
      h AS (SELECT *, coalesce(max(CASE WHEN (company_id + run) % 2 = 0 THEN revision END) OVER (PARTITION BY company_id, story ORDER BY run), 0) AS answered FROM g) SELECT *, revision > answered AS waiting FROM h""",
}
