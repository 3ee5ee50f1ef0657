"""Choices of rows by several orders, quotas that depend on each other, and splits that are
even over all groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.positions import with_positions
from tidewatch.sources.tables import ARTICLES_SQL, articles

#: Earlier articles of a company that may be an article's candidates, and how many each order gives.
HISTORY, BY_TIME, BY_SIGNS, BY_SCORE = 120, 6, 4, 4
#: Rows of a company in a quota, a third of them incidental at most.
QUOTA = 12
FOLDS = 5


def ranked_union(pairs: DataFrame, target: str, candidate: str, orders: dict[str, tuple[list[Column], int]]) -> DataFrame:
    """(target, candidate, orders): the candidates that are among the first n of a target by
    any of the orders, {name: (numbers, larger first; n)}, and by which. Ties go to the smaller
    candidate, null numbers come last.

    Each pair is told once for each order and one window ranks them all, so that the engine
    keeps the first of each target and order in every task before it shuffles anything."""
    number = lambda c: F.coalesce(c.cast("double"), F.lit(float("-inf")))
    each = F.array(*[F.struct(F.lit(name).alias("by"), F.array(*map(number, keys)).alias("keys"), F.lit(n).alias("n")) for name, (keys, n) in orders.items()])
    told = pairs.select(target, candidate, F.explode(each).alias("o")).select(target, candidate, "o.*")
    rank = F.row_number().over(Window.partitionBy(target, "by").orderBy(F.desc("keys"), candidate))
    most = max(n for _, n in orders.values())
    first = told.withColumn("rank", rank).where(F.col("rank") <= most).where("rank <= n")
    return first.groupBy(target, candidate).agg(F.sort_array(F.collect_set("by")).alias("orders"))


def candidate_pairs(rows: DataFrame, history: int = HISTORY) -> DataFrame:
    """Each article with the up to `history` before it in its company, as columns a and b.
    Companies are cut into blocks of `history` positions; an article meets its own block and the
    one before, so no company is one task's."""
    placed = with_positions(rows, ["company_id"], [F.col("seen_at"), F.col("article_id")])
    block = F.floor(F.col("position") / history)
    asked = placed.select(F.struct("*").alias("a"), "company_id", F.explode(F.array(block, block - 1)).alias("block"))
    there = placed.select(F.struct("*").alias("b"), "company_id", block.alias("block"))
    met = asked.join(there, ["company_id", "block"]).where((F.col("b.position") < F.col("a.position")) & (F.col("b.position") >= F.col("a.position") - history))
    return met.select("a", "b")


def ranked_histories(rows: DataFrame, orders: dict[str, tuple[Callable[[Column, Column], list[Column]], int]], history: int = HISTORY) -> DataFrame:
    """(article_id, one column of ids for each order): of the up to `history` articles before one in
    its company the first n by each order, {name: (numbers of an article and an earlier one, larger
    first; n)}. Null numbers come last; the newer first where numbers are equal.

    What `ranked_union` finds among `candidate_pairs`, but pairs are never rows: a window over a
    block and the one before holds an article's history as an array, and arrays are ordered where
    they are; only the first n travel, to articles that share an id."""
    placed = with_positions(rows.where("company_id IS NOT NULL"), ["company_id"], [F.col("seen_at"), F.col("article_id")])
    block = F.floor(F.col("position") / history)
    spread = placed.select("*", block.alias("block"), F.explode(F.array(block, block + 1)).alias("cell"))
    before = Window.partitionBy("company_id", "cell").orderBy("position").rowsBetween(-history, -1)
    met = spread.select("*", F.collect_list(F.struct(*placed.columns)).over(before).alias("earlier")).where("cell = block AND size(earlier) > 0")
    number = lambda c: F.coalesce(c.cast("double"), F.lit(float("-inf")))
    own = F.struct(*placed.columns)

    def first(name):
        keys, n = orders[name]
        told = F.transform("earlier", lambda b: F.struct(*[number(k).alias(f"k{i}") for i, k in enumerate(keys(own, b))], b["position"].alias("position"), b["article_id"].alias("article_id")))
        return F.slice(F.sort_array(told, asc=False), 1, n).alias(name)

    found = met.select("article_id", *map(first, orders)).groupBy("article_id").agg(*[F.flatten(F.collect_list(name)).alias(name) for name in orders])
    return found.select("article_id", *[F.slice(F.sort_array(name, asc=False), 1, n)["article_id"].alias(name) for name, (_, n) in orders.items()])


def ranked_candidates(spark, sf_dir):
    """Of each article the earlier ones of its company to compare it with: the newest, those that
    share most signs (story 4, source 2, label 1), and those nearest in tone. How many these are,
    how many all three orders name, and their ids."""
    rows = articles(spark, sf_dir).select("article_id", "company_id", "seen_at", "story", "source", "label", "negative")
    same = lambda a, b, c, weight: F.when(a[c] == b[c], weight).otherwise(0)
    signs = lambda a, b: same(a, b, "story", 4) + same(a, b, "source", 2) + same(a, b, "label", 1)
    found = ranked_histories(rows, {"time": (lambda a, b: [], BY_TIME), "signs": (lambda a, b: [signs(a, b)], BY_SIGNS), "score": (lambda a, b: [-F.abs(a["negative"] - b["negative"])], BY_SCORE)})
    every = F.array_sort(F.array_distinct(F.concat("time", "signs", "score")))
    by_all = F.size(F.array_intersect(F.array_intersect("time", "signs"), "score"))
    return found.select("article_id", F.size(every).cast("long").alias("candidates"), by_all.cast("long").alias("by_all"), F.array_join(every, ",").alias("candidate_ids"))


def with_quota(rows: DataFrame, group: str, incidental: str, order: Column, title: str, quota: int = QUOTA) -> DataFrame:
    """Up to `quota` rows of each group: first incidental ones, a third at most, then others
    for what these leave, each in `order`; of equal titles the first stays and is not replaced.
    Rows without a title are left out. A task sends on `quota` rows of a group and kind at most."""
    kind = Window.partitionBy(group, incidental).orderBy(order)
    ranked = rows.where(F.col(title).isNotNull() & F.col(group).isNotNull()).withColumn("rank", F.row_number().over(kind)).where(F.col("rank") <= quota)
    taken = F.count_if(F.col(incidental) & (F.col("rank") <= quota // 3)).over(Window.partitionBy(group))
    picked = ranked.withColumn("taken", taken).where(F.when(F.col(incidental), F.col("rank") <= quota // 3).otherwise(F.col("rank") <= quota - F.col("taken")))
    once = F.row_number().over(Window.partitionBy(group, title).orderBy(F.desc(incidental), "rank"))
    return picked.withColumn("once", once).where("once = 1").drop("once", "taken")


def incidental_quota(spark, sf_dir):
    """A sample of each company's articles to label, in an order by hash: clicks count as
    incidental, a story stands for a title."""
    rows = articles(spark, sf_dir).select("company_id", "article_id", "story", (F.col("source") == "click").alias("incidental"))
    hashed = F.struct(F.md5(F.concat(F.lit("quota|"), F.col("article_id").cast("string"))), F.col("article_id"))
    return with_quota(rows, "company_id", "incidental", hashed.asc(), "story").select("company_id", "article_id", "story", "incidental", F.col("rank").cast("long").alias("rank"))


def even_folds(groups: DataFrame, label: str, size: str, order: list[Column], folds: int = FOLDS) -> DataFrame:
    """groups with a `fold` from 0: groups of a label are dealt back and forth, largest first,
    over all of them. So the folds' numbers of groups of a label differ by one at most, and
    their sizes by no more than the largest group of that label."""
    placed = with_positions(groups, [label], [F.desc(size), *order])
    turn, place = F.floor(F.col("position") / folds), F.col("position") % folds
    return placed.withColumn("fold", F.when(turn % 2 == 0, place).otherwise(folds - 1 - place).cast("long")).drop("position")


def even_group_folds(spark, sf_dir):
    """Stories of all companies in five folds, even in risky and other stories and in articles."""
    risky = F.max((F.col("negative") >= 0.85).cast("int"))
    groups = articles(spark, sf_dir).groupBy("company_id", "story").agg(risky.alias("y"), F.count(F.lit(1)).alias("n"))
    return even_folds(groups, "y", "n", [F.col("company_id").asc_nulls_first(), F.col("story").asc_nulls_first()])


def split_in_time(groups: DataFrame, order: list[Column], train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """groups with a `split`: the first share of all in `order` is for training, the next for
    validation, the rest for tests."""
    placed = with_positions(groups, [], order)
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    share = (F.col("position") + 1) / F.col("total")
    split = F.when(share <= train, "train").when(share <= train + validation, "validation").otherwise("test")
    return placed.join(F.broadcast(total), F.lit(True)).withColumn("split", split).drop("position", "total")  # one row


def timed_group_split(spark, sf_dir):
    """Stories of all companies by the time of their first article: 70 / 15 / 15, none is split."""
    groups = articles(spark, sf_dir).groupBy("company_id", "story").agg(F.min("seen_at").alias("first_at"))
    return split_in_time(groups, [F.col("first_at"), F.col("company_id").asc_nulls_first(), F.col("story").asc_nulls_first()]).drop("first_at")


QUERIES = {f.__name__: f for f in (ranked_candidates, incidental_quota, even_group_folds, timed_group_split)}

ORACLE_SQL = {
    "ranked_candidates": f"""WITH {ARTICLES_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY seen_at, article_id) AS position FROM articles),
      m AS (SELECT a.article_id, b.article_id AS candidate_id, b.position, abs(a.negative - b.negative) AS apart,
        CASE WHEN a.story = b.story THEN 4 ELSE 0 END + CASE WHEN a.source = b.source THEN 2 ELSE 0 END + CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS signs
        FROM p a JOIN p b ON a.company_id = b.company_id AND b.position BETWEEN a.position - {HISTORY} AND a.position - 1),
      r AS (SELECT *, (row_number() OVER (PARTITION BY article_id ORDER BY position DESC, candidate_id) <= {BY_TIME})::INT AS t, (row_number() OVER (PARTITION BY article_id ORDER BY signs DESC, position DESC, candidate_id) <= {BY_SIGNS})::INT AS g,
        (row_number() OVER (PARTITION BY article_id ORDER BY apart, position DESC, candidate_id) <= {BY_SCORE})::INT AS s FROM m)
      SELECT article_id, count(*) AS candidates, count(*) FILTER (WHERE t + g + s = 3) AS by_all, string_agg(candidate_id, ',' ORDER BY candidate_id) AS candidate_ids FROM r WHERE t + g + s > 0 GROUP BY 1""",
    "incidental_quota": f"""WITH {ARTICLES_SQL}, k AS (SELECT company_id, article_id, story, source = 'click' AS incidental FROM articles WHERE story IS NOT NULL AND company_id IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY company_id, incidental ORDER BY md5('quota|' || article_id), article_id) AS rank FROM k),
      n AS (SELECT company_id, least(count(*) FILTER (WHERE incidental), {QUOTA // 3}) AS taken FROM k GROUP BY 1),
      q AS (SELECT r.*, row_number() OVER (PARTITION BY company_id, story ORDER BY incidental DESC, rank) AS once FROM r JOIN n USING (company_id) WHERE rank <= CASE WHEN incidental THEN {QUOTA // 3} ELSE {QUOTA} - taken END)
      SELECT company_id, article_id, story, incidental, rank FROM q WHERE once = 1""",
    "even_group_folds": f"""WITH {ARTICLES_SQL}, g AS (SELECT company_id, story, CAST(max((negative >= 0.85::DOUBLE)::INT) AS INT) AS y, count(*) AS n FROM articles GROUP BY ALL),
      p AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY n DESC, company_id NULLS FIRST, story NULLS FIRST) - 1 AS pos FROM g)
      SELECT company_id, story, y, n, CASE WHEN pos // {FOLDS} % 2 = 0 THEN pos % {FOLDS} ELSE {FOLDS - 1} - pos % {FOLDS} END AS fold FROM p""",
    "timed_group_split": f"""WITH {ARTICLES_SQL}, g AS (SELECT company_id, story, min(seen_at) AS first_at FROM articles GROUP BY ALL),
      p AS (SELECT company_id, story, row_number() OVER (ORDER BY first_at, company_id NULLS FIRST, story NULLS FIRST)::DOUBLE / count(*) OVER () AS share FROM g)
      SELECT company_id, story, CASE WHEN share <= 0.7::DOUBLE THEN 'train' WHEN share <= 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'test' END AS split FROM p""",
}
