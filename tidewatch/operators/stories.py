"""Stories from articles: tokens, similarity of pairs, matching, components, representatives,
repair of repeated titles, features of a story."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.batches import by_key
from tidewatch.functions.components import components, linked_by
from tidewatch.functions.positions import with_positions
from tidewatch.operators.filtering import COMMENTS, ITEMS_SQL, first_near, items, seconds
from tidewatch.sources.scratch import cut, written
from tidewatch.sources.tables import ARTICLES_SQL, articles, table

# Words of headlines that tell nothing (fixed values).
STOP_TOKENS = [
    "관련", "대해", "대한", "위해", "통해", "나서", "돌입", "착수", "밝혀", "밝혔다", "진행", "예정", "기자", "뉴스", "속보", "종합", "단독", "영상", "포토", "오늘", "어제", "오전", "오후",
]
# Marks before a headline (fixed values).
LEADING_MARK = "^(?:[ \\t]*[\\[('‘\"][ \\t]*(?:속보|종합|단독|영상|포토|그래픽|현장)[ \\t]*[\\])'’\"][ \\t]*)+"
#: Concepts of events in the documents' words, with their weights.
CONCEPTS = [("action:recall", ["thor", "attion"], 1.4), ("action:strike", ["erin"], 1.4), ("incident:fire", ["stand", "onan"], 1.5), ("incident:fall", ["anea"], 1.4), ("object:site", ["erble"], 0.7), ("agency:court", ["queau", "than"], 0.6)]
#: Hours apart at most for a match by recent signs, and for a follow-up.
RECENT, FOLLOW_UP = 168, 720
BODY = 900
#: Items of a company in a block; two blocks are compared in one task.
TILE = 2_000
#: What a title keeps nothing of when titles are compared as evidence.
NO_LETTER = "[^\\p{L}\\p{N}_]"


def story_text(text: Column) -> Column:
    """Text in lower case without tags, references, headline marks and runs of blanks."""
    return T.normalized(F.regexp_replace(F.coalesce(text, F.lit("")), LEADING_MARK, ""))


def story_text_sql(text: str) -> str:
    mark = LEADING_MARK.replace("'", "''")
    return T.normalized_sql(f"regexp_replace(coalesce({text}, ''), '{mark}', '')")


def story_tokens(norm: Column) -> Column:
    """Different tokens of two characters or more that are no headline words."""
    return F.array_except(F.filter(T.tokens(norm, T.STORY_TOKEN), lambda t: F.char_length(t) > 1), F.array(*map(F.lit, STOP_TOKENS)))


def story_tokens_sql(norm: str) -> str:
    stop = ", ".join(f"'{t}'" for t in STOP_TOKENS)
    return f"list_distinct(list_filter(regexp_extract_all({norm}, '{T.STORY_TOKEN}'), lambda t: length(t) > 1 AND t NOT IN ({stop})))"


def compact(norm: Column) -> Column:
    return F.array_join(F.regexp_extract_all(norm, F.lit(T.STORY_TOKEN), F.lit(0)), "")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts, for which the engine has no function."""

    @F.pandas_udf("double")
    def ratio(left, right):
        import difflib

        import pandas as pd

        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)], dtype=float)

    return ratio(a, b)


def prepared(rows: DataFrame) -> DataFrame:
    """Items with what matching needs: normalised title and body, their tokens and runs of
    three characters, concepts, seconds of publication or else collection."""
    out = rows.withColumns({"t": story_text(F.col("title")), "body": F.substr(story_text(F.col("summary")), F.lit(1), F.lit(BODY))})
    out = out.withColumns({"tt": story_tokens(F.col("t")), "bt": story_tokens(F.col("body")), "tc": compact(F.col("t")), "bc": compact(F.col("body"))})
    text = F.concat_ws(" ", "t", "body")
    has = [F.when(sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0, F.struct(F.lit(key).alias("key"), F.lit(weight).alias("weight"))) for key, words, weight in CONCEPTS]
    return out.withColumns({"tg": T.trigrams(F.col("tc")), "bg": T.trigrams(F.col("bc")), "concepts": F.array_compact(F.array(*has)), "at": seconds("published_at")}).withColumn("at", F.coalesce("at", seconds("collected_at")))


def lexical(a: str, b: str, ratio: Column) -> Column:
    """Similarity of title and body of two prepared items: 1 for equal titles."""
    c = lambda side, name: F.col(f"{side}.{name}")
    title = F.greatest(T.containment(c(a, "tt"), c(b, "tt")) * 0.52 + T.dice(c(a, "tg"), c(b, "tg")) * 0.48, ratio * 0.55 + T.jaccard(c(a, "tt"), c(b, "tt")) * 0.45)
    body = F.greatest(T.containment(c(a, "bt"), c(b, "bt")) * 0.55 + T.jaccard(c(a, "bt"), c(b, "bt")) * 0.45, T.dice(c(a, "bg"), c(b, "bg")))
    whole = F.when((c(a, "body") == "") | (c(b, "body") == ""), title).otherwise(F.least(title * 0.78 + body * 0.22, F.lit(1.0)))
    return F.when((c(a, "t") == "") | (c(b, "t") == ""), 0.0).when(c(a, "tc") == c(b, "tc"), 1.0).otherwise(F.round(whole, 6))


def brief(rows: DataFrame) -> DataFrame:
    """Of `prepared` items what tasks need to find the rest: texts, concepts, seconds."""
    return prepared(rows).select("company_id", "raw_id", F.col("at").cast("long").alias("at"), "t", "body", "concepts")


def _pairs_of_tiles(batches, scored: bool = True):
    """Rows of tiles, each tile's together, to its pairs that may match whatever the rounding:
    ids a < b, similarity before rounding, equal titles, shared concepts, hours apart. If not
    `scored`, to fewer pairs that link the same items: those that are linked by now are not
    looked at, and the sequence ratio is taken last, of what is still apart."""
    import numpy as np
    import pyarrow as pa

    from tidewatch.functions.likeness import Titles

    keys, step, lot, slack = [key for key, _, _ in CONCEPTS], 256, 4_096, 2e-6
    sets = np.arange(1 << len(keys))[:, None] >> np.arange(len(keys)) & 1
    weight_of = sum((sets[:, k] * CONCEPTS[k][2] for k in range(len(keys))), np.zeros(len(sets)))
    high_of = sets[:, [key.startswith(("action:", "incident:")) for key in keys]].sum(axis=1)
    need_of = np.where((high_of >= 2) & (weight_of >= 3.0), 0.30, np.where((high_of >= 1) & (weight_of >= 1.8), 0.43, 0.66))
    names = ["a", "b", "whole", "exact", "shared", "high", "hours"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.float64(), pa.int32(), pa.float64()]

    def told(rows):
        rows.sort(key=lambda r: (r["own"], r["raw_id"]))
        own = sum(not r["own"] for r in rows)  # the second block's, or both blocks' in a tile of one block
        first, second = (slice(0, own), slice(own, len(rows))) if own < len(rows) else (slice(0, own),) * 2
        items = Titles([(r["t"], r["body"]) for r in rows], [{c["key"]: c["weight"] for c in r["concepts"]} for r in rows], frozenset(STOP_TOKENS), keys)
        ids, at = np.array([r["raw_id"] for r in rows], np.int64), np.array([r["at"] for r in rows], np.int64)
        has, full = items.has @ (1 << np.arange(len(keys))), ~items.empty_title
        parents, roots = list(range(len(rows))), np.arange(len(rows))

        def root(i):
            while parents[i] != i:
                parents[i] = i = parents[parents[i]]
            return i

        def joined(i, j):
            """Which of the pairs link what was apart; they do so from now on."""
            nonlocal roots
            new = roots[i] != roots[j]
            for k in np.flatnonzero(new).tolist():
                a, b = root(int(i[k])), root(int(j[k]))
                parents[max(a, b)] = min(a, b)
                new[k] = a != b
            roots = np.array(parents)
            while (roots != roots[roots]).any():
                roots = roots[roots]
            return new

        def pairs(i, j, whole, exact):
            both = has[i] & has[j]
            columns = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), whole, exact, weight_of[both], high_of[both], np.abs(at[i] - at[j]) / 3600
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

        def by_ratio(i, j, need, parts):
            """The similarities of pairs; where they miss `need`, less than that."""
            fixed, near, body, bare = parts
            least = np.maximum(np.where(bare, need, (need - body * 0.22) / 0.78), fixed)  # below, the ratio tells nothing
            ordered = ids[i] < ids[j]
            return items.whole(parts, items.ratios(np.where(ordered, i, j), np.where(ordered, j, i), (least - near * 0.45) / 0.55 - 1e-7))

        later = []
        for start in range(first.start, first.stop, step):
            part = slice(start, min(start + step, first.stop))
            shared = items.shared(part, second)
            apart, common = np.abs(at[part, None] - at[None, second]), has[part, None] & has[None, second]
            need = np.where(apart > FOLLOW_UP * 3600, np.inf, np.where(apart > RECENT * 3600, 0.78, need_of[common]))
            ok = full[part, None] & full[None, second]
            ok &= ids[part, None] < ids[None, second] if first == second else ids[part, None] != ids[None, second]
            same = items.same[part, None] == items.same[None, second]
            i, j = np.nonzero(ok & same & (apart <= FOLLOW_UP * 3600) & ((items.length[part, None] > 0) | (high_of[common] > 0)))
            i, j = i + part.start, j + second.start
            exact = items.length[i] > 0
            if not scored:
                exact[exact] = kept = joined(i[exact], j[exact])
                i, j = (np.concatenate([x[items.length[i] == 0], x[exact]]) for x in (i, j))
                exact = np.arange(len(i)) >= len(i) - int(kept.sum())
                ok &= roots[part, None] != roots[None, second]
            if len(i):
                yield pairs(i, j, np.ones(len(i)), exact)

            i, j = np.nonzero(ok & ~same & (items.upper(part, second, shared) >= need - 1e-3))
            need = need[i, j] - 1e-6
            parts = items.parts(i + part.start, j + second.start, {k: m[i, j] for k, m in shared.items()})
            i, j = i + part.start, j + second.start
            if not scored:
                low = items.whole(parts, 0.0)
                sure = np.flatnonzero(low >= need + slack)
                sure = sure[joined(i[sure], j[sure])]
                if len(sure):
                    yield pairs(i[sure], j[sure], low[sure], np.zeros(len(sure), bool))
            left = np.flatnonzero((items.whole(parts, items.upper_ratio(i, j)) >= need) & (scored | (roots[i] != roots[j])))
            i, j, need, parts = i[left], j[left], need[left], [p[left] for p in parts]
            left = np.flatnonzero(items.whole(parts, items.upper_ratio(i, j, close=True)) >= need)
            i, j, need, parts = i[left], j[left], need[left], [p[left] for p in parts]
            if not scored:
                later.append((i, j, need, *parts))
                continue
            whole = by_ratio(i, j, need, parts)
            left = np.flatnonzero(whole >= need)
            if len(left):
                yield pairs(i[left], j[left], whole[left], np.zeros(len(left), bool))

        if later:
            i, j, need, *parts = (np.concatenate(x) for x in zip(*later))
            order = np.argsort(need - items.whole(parts, 0.0), kind="stable")  # what is likely to link comes first
            while len(order):
                order = order[roots[i[order]] != roots[j[order]]]
                now, order = order[:lot], order[lot:]
                whole = by_ratio(i[now], j[now], need[now], [p[now] for p in parts])
                sure = whole >= need[now] + slack
                keep = (whole >= need[now]) & ~sure
                keep[sure] = joined(i[now[sure]], j[now[sure]])
                if keep.any():
                    yield pairs(i[now[keep]], j[now[keep]], whole[keep], np.zeros(int(keep.sum()), bool))

    yield from by_key(batches, ["company_id", "i", "j"], told)


def matched_pairs(rows: DataFrame, scored: bool = True) -> DataFrame:
    """Pairs of a company's items that tell one event (raw ids a < b, score): lexical
    similarity, shared concepts and hours apart decide.

    Common words bring most of a company's items together, so all pairs within thirty days
    are compared: a company's items in order of time are cut into blocks of TILE, and two
    blocks that are near enough are a task's tile. A tile compares by arrays and takes the
    sequence ratio only of pairs that could still match, of many pairs at once; nothing but
    texts going to tiles and matched pairs is shuffled. The work is quadratic in the items of thirty days. If not
    `scored`, only pairs (a, b) that link the same items as all do: a tile's, a tree."""
    light = written(brief(rows).where("company_id IS NOT NULL AND raw_id IS NOT NULL AND at IS NOT NULL"))  # read twice
    placed = written(with_positions(light, ["company_id"], [F.col("at"), F.col("raw_id")]).withColumn("block", F.floor(F.col("position") / TILE)).drop("position"))
    blocks = placed.groupBy("company_id", "block").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    near = (F.col("x.company_id") == F.col("y.company_id")) & (F.col("x.block") <= F.col("y.block")) & (F.col("y.first") - F.col("x.last") <= FOLLOW_UP * 3600)
    tiles = blocks.alias("x").join(blocks.alias("y"), near).select("x.company_id", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    roles = tiles.select("*", F.col("i").alias("block"), F.lit(False).alias("own")).unionByName(tiles.where("i <> j").select("*", F.col("j").alias("block"), F.lit(True).alias("own")))
    tasks = max(tiles.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # fixed, as the work is large for the bytes
    dealt = placed.join(roles, ["company_id", "block"]).drop("block").repartition(tasks, "company_id", "i", "j").sortWithinPartitions("company_id", "i", "j")
    met = dealt.mapInArrow(lambda batches: _pairs_of_tiles(batches, scored), "a long, b long, whole double, exact boolean, shared double, high int, hours double").withColumn("lex", F.round("whole", 6))
    recent = (F.col("lex") >= 0.66) | ((F.col("lex") >= 0.43) & (F.col("high") >= 1) & (F.col("shared") >= 1.8)) | ((F.col("lex") >= 0.30) & (F.col("high") >= 2) & (F.col("shared") >= 3.0))
    matched = F.col("exact") | F.when(F.col("hours") <= RECENT, recent).otherwise(F.col("lex") >= 0.78)
    score = F.when(F.col("exact"), 1.0).otherwise(F.least(F.lit(1.0), F.col("lex") * 0.60 + F.least(F.lit(1.0), F.col("shared") / 5) * 0.10))
    return met.where(matched).select("a", "b", *([F.round(score, 6).alias("score")] if scored else []))


def story_pairs(spark, sf_dir):
    """Matched pairs of items."""
    return matched_pairs(items(spark, sf_dir))


def story_clusters(spark, sf_dir):
    """Each item's story: the smallest id that matches reach, so that every item of a
    component has one story."""
    roots = components(matched_pairs(items(spark, sf_dir), scored=False)).withColumnRenamed("node", "raw_id")
    return items(spark, sf_dir).select("raw_id").join(roots, "raw_id", "left").select("raw_id", F.coalesce("root", "raw_id").alias("story"))


def representatives(spark, sf_dir):
    """Of each story, here a company's items of one language, the item that stands for it:
    most concepts, a summary, a title of up to 100 characters as long as may be, the first."""
    rows = prepared(items(spark, sf_dir))
    key = F.struct(F.size("concepts").alias("n"), (F.col("summary") != "").alias("has"), F.least(F.char_length("t"), F.lit(100)).alias("length"), (-F.col("raw_id")).alias("first"))
    return rows.groupBy("company_id", "lang").agg(F.max(F.struct(key.alias("key"), "raw_id")).alias("x"), F.count(F.lit(1)).alias("items")).select("company_id", "lang", "x.raw_id", F.col("x.key.n").cast("long").alias("concepts"), "items")


def story_fingerprints(spark, sf_dir):
    """A digest of a title's sorted tokens and day; how many tokens, and runs of three
    characters, a title has."""
    rows = prepared(items(spark, sf_dir))
    day = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd")
    material = F.concat(F.lit("story-cluster-v2|"), F.array_join(F.array_sort("tt"), " "), F.lit("|"), day)
    return rows.select("raw_id", F.sha2(material, 256).alias("fingerprint"), F.size("tt").cast("long").alias("n_tokens"), F.size("tg").cast("long").alias("n_trigrams"))


def title_repair(spark, sf_dir):
    """Repeated titles: each item's parent is the first earlier one of its title within
    fifteen minutes; the end of such a chain is the root, which survives."""
    rows = items(spark, sf_dir).where(F.coalesce(F.col("source"), F.lit("")) != COMMENTS).withColumn("n", T.normalized(F.col("title"))).where("n <> ''")
    parents = cut(first_near(rows.select("raw_id", F.md5("n").alias("title"), seconds("published_at").alias("published"), seconds("collected_at").alias("collected"))).withColumnRenamed("of_title", "parent"))
    roots = parents.select("raw_id", F.col("parent").alias("root"))
    while True:
        up = roots.join(parents.select(F.col("raw_id").alias("root"), "parent"), "root", "left")
        new = cut(up.select("raw_id", F.coalesce("parent", "root").alias("root"), F.col("parent").isNotNull().alias("moved")))
        roots = new.select("raw_id", "root")
        if new.where("moved").isEmpty():
            return parents.join(roots, "raw_id").select("raw_id", "parent", "root")


def story_features(spark, sf_dir):
    """Numbers of a story over its first eight articles of the first day: logarithms of
    articles and publishers, repeated titles, span, recent share, sentiment and what is
    missing of it, official sources."""
    of = Window.partitionBy("company_id", "story")
    rows = articles(spark, sf_dir).withColumns({"first_at": F.min("created_at").over(of), "n": F.row_number().over(of.orderBy("created_at", "article_id"))})
    rows = rows.where((F.col("created_at") < F.col("first_at") + F.expr("INTERVAL 24 HOURS")) & (F.col("n") <= 8))
    at, known = F.unix_seconds(F.col("created_at").cast("timestamp")), F.when(F.col("article_id") % 5 != 0, F.col("negative"))
    end = F.unix_seconds((F.col("first_at") + F.expr("INTERVAL 24 HOURS")).cast("timestamp"))
    n = F.count(F.lit(1))
    return rows.groupBy("company_id", "story").agg(
        F.round(F.log1p(n), 6).alias("log_articles"), F.round(F.log1p(F.countDistinct("source")), 6).alias("log_publishers"), F.round(1 - F.countDistinct("label") / n, 6).alias("repeated_titles"),
        F.round((F.max(at) - F.min(at)) / 3600, 6).alias("span_hours"), F.round(F.avg((end - at <= 21_600).cast("double")), 6).alias("recent"), F.round(F.coalesce(F.avg(known), F.lit(0.0)), 6).alias("negative_mean"),
        F.round(F.coalesce(F.max(known), F.lit(0.0)), 6).alias("negative_max"), F.round(F.coalesce(F.stddev_pop(known), F.lit(0.0)), 6).alias("negative_std"), F.round(1 - F.count(known) / n, 6).alias("missing"), F.round(F.avg((F.col("source") == "purchase").cast("double")), 6).alias("official"),
    )


def masked_names(spark, sf_dir):
    """Texts with a company's names masked, longest first and whatever their case; names of
    one character stay. Told as digests."""
    names = sorted(["Thor", "thorough", "an", "Stand", "e"], key=lambda n: (-len(n), n))
    out = F.lower(F.coalesce("text", F.lit("")))
    for name in names:
        if len(name) >= 2:
            out = F.replace(out, F.lit(name.lower()), F.lit(" 대상기업 "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("digest"), F.contains(out, F.lit("대상기업")).alias("masked"))


def evidence(spark, sf_dir) -> DataFrame:
    """(raw_id, split, kind, token): what tells that two items are about one event: an address,
    or a title of letters and digits alone; empty titles tell nothing. Half of the items are to
    train (split by id), a tenth each to validate and to test; the rest only links others."""
    rows = items(spark, sf_dir)
    title = F.regexp_replace(F.lower("title"), NO_LETTER, "")
    split = F.when(F.col("raw_id") % 10 == 0, "test").when(F.col("raw_id") % 10 == 1, "validation").when(F.col("raw_id") % 10 < 7, "train").otherwise("unused")
    told = F.explode(F.array(F.struct(F.lit("title").alias("kind"), F.when(title != "", title).alias("token")), F.struct(F.lit("url").alias("kind"), T.normalized_url(F.col("url")).alias("token"))))
    return rows.select("raw_id", split.alias("split"), told.alias("x")).select("raw_id", "split", "x.kind", F.concat_ws("|", "x.kind", "x.token").alias("token"), F.col("x.token").isNotNull().alias("told")).where("told").drop("told")


def exposed_items(spark, sf_dir):
    """Test items that share evidence with items to train or validate, straight or over any
    other items in between: those a comparison of models must leave out. Also which kinds of
    evidence they share straight."""
    each = evidence(spark, sf_dir)
    nodes = each.select("raw_id", "split").distinct()
    roots = components(linked_by(each, "raw_id", "token")).withColumnRenamed("node", "raw_id")
    placed = nodes.join(roots, "raw_id", "left").withColumn("root", F.coalesce("root", "raw_id"))
    is_a = lambda split: F.bool_or(F.col("split") == split)
    seeds = placed.groupBy("root").agg(is_a("train").alias("by_train"), is_a("validation").alias("by_validation"))
    direct = each.groupBy("token").agg(F.bool_or(F.col("split").isin("train", "validation")).alias("seeded")).where("seeded")
    kinds = each.where("split = 'test'").join(direct, "token", "left_semi").groupBy("raw_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("direct"))
    found = placed.where("split = 'test'").join(seeds, "root").join(kinds, "raw_id", "left")
    return found.select("raw_id", "by_train", "by_validation", F.coalesce("direct", F.lit("")).alias("direct"), (F.col("by_train") | F.col("by_validation")).alias("exposed"))


def compared_models(spark, sf_dir):
    """Two models on the labelled test items that neither has seen evidence of: for each the
    counts of right and wrong answers. Long titles and many tokens stand for the models'
    answers; how many items were left out, and why, is told beside them."""
    tested = exposed_items(spark, sf_dir).join(table(spark, sf_dir, "labels").where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("raw_id")).agg(F.max("quality").alias("quality")), "raw_id")
    answers = prepared(items(spark, sf_dir)).select("raw_id", F.explode(F.array(F.struct(F.lit("baseline").alias("model"), (F.char_length("t") > 20).alias("yes")), F.struct(F.lit("candidate").alias("model"), (F.size("tt") >= 3).alias("yes")))).alias("x"))
    rows = tested.join(answers, "raw_id").select("*", "x.*")
    kept, good = ~F.col("exposed"), F.col("quality") == 1
    return rows.groupBy("model").agg(
        F.count_if(kept & good & F.col("yes")).alias("tp"), F.count_if(kept & ~good & F.col("yes")).alias("fp"), F.count_if(kept & good & ~F.col("yes")).alias("fn"), F.count_if(kept & ~good & ~F.col("yes")).alias("tn"),
        F.count_if("exposed").alias("left_out"), F.count_if(F.col("exposed") & (F.col("direct") == "")).alias("left_out_over_others"),
    )


QUERIES = {f.__name__: f for f in (story_pairs, story_clusters, representatives, story_fingerprints, title_repair, story_features, masked_names, exposed_items, compared_models)}

_T = f"p AS (SELECT *, {story_text_sql('title')} AS t, substr({story_text_sql('summary')}, 1, {BODY}) AS body FROM items), q AS (SELECT *, {story_tokens_sql('t')} AS tt, array_to_string(regexp_extract_all(t, '{T.STORY_TOKEN}'), '') AS tc FROM p)"
_CONCEPTS_SQL = " + ".join("(" + " OR ".join(f"contains(concat_ws(' ', t, body), '{w}')" for w in words) + ")::INT" for _, words, _ in CONCEPTS)
_NEAR = "CASE WHEN a.published_at IS NOT NULL AND b.published_at IS NOT NULL THEN abs(epoch(a.published_at) - epoch(b.published_at)) ELSE abs(epoch(a.collected_at) - epoch(b.collected_at)) END <= 900"
_MASKS = [n.lower() for n in sorted(["Thor", "thorough", "an", "Stand"], key=lambda n: (-len(n), n))]
_MASKED = "lower(coalesce(text, ''))"
for _name in _MASKS:
    _MASKED = f"replace({_MASKED}, '{_name}', ' 대상기업 ')"
_EXPOSED_SQL = f"""{ITEMS_SQL}, told AS (SELECT raw_id, CASE WHEN raw_id % 10 = 0 THEN 'test' WHEN raw_id % 10 = 1 THEN 'validation' WHEN raw_id % 10 < 7 THEN 'train' ELSE 'unused' END AS split, unnest(['title', 'url']) AS kind, unnest([nullif(regexp_replace(lower(title), '{NO_LETTER}', '', 'g'), ''), {T.normalized_url_sql('url')}]) AS value FROM items),
  each_token AS (SELECT raw_id, split, kind, kind || '|' || value AS token FROM told WHERE value IS NOT NULL), near AS (SELECT DISTINCT a.raw_id AS a, b.raw_id AS b FROM each_token a JOIN each_token b USING (token)),
  reach AS (SELECT raw_id, raw_id AS spot FROM each_token WHERE split = 'test' UNION SELECT raw_id, b FROM reach JOIN near ON spot = a), splits AS (SELECT DISTINCT raw_id, split FROM each_token),
  by_split AS (SELECT r.raw_id, bool_or(split = 'train') AS by_train, bool_or(split = 'validation') AS by_validation FROM reach r JOIN splits s ON s.raw_id = r.spot GROUP BY 1),
  kinds AS (SELECT a.raw_id, array_to_string(list_sort(list(DISTINCT a.kind)), ',') AS direct FROM each_token a WHERE split = 'test' AND EXISTS (SELECT 1 FROM each_token o WHERE o.token = a.token AND o.split IN ('train', 'validation')) GROUP BY 1),
  exposed_test AS (SELECT raw_id, by_train, by_validation, coalesce(direct, '') AS direct, by_train OR by_validation AS exposed FROM by_split LEFT JOIN kinds USING (raw_id))"""
ORACLE_SQL = {
    "representatives": f"""WITH {ITEMS_SQL}, {_T}, c AS (SELECT raw_id, company_id, lang, CAST({_CONCEPTS_SQL} AS BIGINT) AS concepts, summary <> '' AS has, least(length(t), 100) AS len FROM q) SELECT company_id, lang, raw_id, concepts, count(*) OVER (PARTITION BY company_id, lang) AS items FROM c QUALIFY row_number() OVER (PARTITION BY company_id, lang ORDER BY concepts DESC, has DESC, len DESC, raw_id) = 1""",
    "story_fingerprints": f"""WITH {ITEMS_SQL}, {_T} SELECT raw_id, sha256('story-cluster-v2|' || array_to_string(list_sort(tt), ' ') || '|' || strftime(coalesce(published_at, collected_at), '%Y-%m-%d')) AS fingerprint, CAST(len(tt) AS BIGINT) AS n_tokens, CAST(len({T.trigrams_sql('tc')}) AS BIGINT) AS n_trigrams FROM q""",
    "title_repair": f"""WITH RECURSIVE {ITEMS_SQL}, s AS (SELECT *, {T.normalized_sql('title')} AS n FROM items WHERE coalesce(source, '') <> '{COMMENTS}'), p AS (SELECT a.raw_id, min(b.raw_id) AS parent FROM s a JOIN s b ON a.n = b.n AND a.n <> '' AND b.raw_id < a.raw_id AND {_NEAR} GROUP BY 1),
      r AS (SELECT raw_id, parent AS root FROM p UNION ALL SELECT r.raw_id, p.parent FROM r JOIN p ON r.root = p.raw_id) SELECT p.raw_id, p.parent, min(root) AS root FROM p JOIN r USING (raw_id) GROUP BY ALL""",
    "story_features": f"""WITH {ARTICLES_SQL}, r AS (SELECT *, min(created_at) OVER (PARTITION BY company_id, story) AS first_at, row_number() OVER (PARTITION BY company_id, story ORDER BY created_at, article_id) AS n FROM articles), k AS (SELECT *, floor(epoch(created_at)) AS sec, floor(epoch(first_at + INTERVAL 24 HOURS)) AS fin, CASE WHEN article_id % 5 <> 0 THEN negative END AS known FROM r WHERE created_at < first_at + INTERVAL 24 HOURS AND n <= 8)
      SELECT company_id, story, round(ln(1 + count(*)), 6) AS log_articles, round(ln(1 + count(DISTINCT source)), 6) AS log_publishers, round(1 - count(DISTINCT label) / count(*), 6) AS repeated_titles, round((max(sec) - min(sec)) / 3600, 6) AS span_hours, round(avg((fin - sec <= 21600)::INT), 6) AS recent, round(coalesce(avg(known), 0), 6) AS negative_mean, round(coalesce(max(known), 0), 6) AS negative_max,
      round(coalesce(stddev_pop(known), 0), 6) AS negative_std, round(1 - count(known) / count(*), 6) AS missing, round(avg((source = 'purchase')::INT), 6) AS official FROM k GROUP BY ALL""",
    "masked_names": f"SELECT doc_id, md5({_MASKED}) AS digest, contains({_MASKED}, '대상기업') AS masked FROM documents",
    "exposed_items": f"""WITH RECURSIVE {_EXPOSED_SQL} SELECT * FROM exposed_test""",
    "compared_models": f"""WITH RECURSIVE {_EXPOSED_SQL}, {_T}, y AS (SELECT doc_id AS raw_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1), m AS (SELECT raw_id, unnest(['baseline', 'candidate']) AS model, unnest([length(t) > 20, len(tt) >= 3]) AS yes FROM q), r AS (SELECT * FROM exposed_test JOIN y USING (raw_id) JOIN m USING (raw_id))
      SELECT model, count(*) FILTER (WHERE NOT exposed AND quality = 1 AND yes) AS tp, count(*) FILTER (WHERE NOT exposed AND quality <> 1 AND yes) AS fp, count(*) FILTER (WHERE NOT exposed AND quality = 1 AND NOT yes) AS fn, count(*) FILTER (WHERE NOT exposed AND quality <> 1 AND NOT yes) AS tn,
      count(*) FILTER (WHERE exposed) AS left_out, count(*) FILTER (WHERE exposed AND direct = '') AS left_out_over_others FROM r GROUP BY model""",
}
