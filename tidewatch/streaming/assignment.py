"""Stories as articles arrive: each one joins the story of the earlier article of its
company that it matches best, or founds a story of its own.

What an article joins depends on earlier articles alone, not on their stories. So a replay
of all articles finds each one's best match in parallel, by company and span of time, and
stories are the ends of the chains; a stream keeps a company's recent articles as state
and knows their stories already. Both take each article in order of time, then of id.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.positions import with_positions
from tidewatch.operators.filtering import items
from tidewatch.operators.stories import FOLLOW_UP, RECENT, STOP_TOKENS, prepared
from tidewatch.sources.scratch import discard, written

#: Recent articles an article is compared with, and of these the ones that may match (fixed values).
CANDIDATES, COMPARED = 1_500, 80
#: Columns of an article, and those that are sets of strings.
FIELDS = "raw_id long, company_id long, at long, fingerprint string, t string, body string, tt array<string>, bt array<string>, tc string, bc string, tg array<string>, bg array<string>, concepts array<struct<key:string,weight:double>>"
SETS = ("tt", "bt", "tg", "bg")
HIGH = ("action:", "incident:")


@dataclass(slots=True)
class Article:
    raw_id: int
    at: int
    fingerprint: str
    t: str
    body: str
    tt: frozenset
    bt: frozenset
    tc: str
    tg: frozenset
    bg: frozenset
    concepts: dict
    story: str | None = None

    @staticmethod
    def of(row: dict) -> Article:
        sets = {k: frozenset(row[k]) for k in SETS}
        return Article(row["raw_id"], row["at"], row["fingerprint"], row["t"], row["body"], tc=row["tc"], concepts={c["key"]: c["weight"] for c in row["concepts"]}, **sets)


def _share(a: frozenset, b: frozenset) -> tuple[float, float, float]:
    """Containment, Jaccard and Dice of two sets, 0 if one is empty."""
    if not a or not b:
        return 0.0, 0.0, 0.0
    both = len(a & b)
    return both / min(len(a), len(b)), both / (len(a) + len(b) - both), 2 * both / (len(a) + len(b))


def lexical(a: Article, b: Article, ratio: float) -> float:
    """The similarity of `stories.lexical` for one pair, given the titles' sequence ratio."""
    if not a.t or not b.t:
        return 0.0
    if a.tc == b.tc:
        return 1.0
    contained, jaccard, _ = _share(a.tt, b.tt)
    title = max(contained * 0.52 + _share(a.tg, b.tg)[2] * 0.48, ratio * 0.55 + jaccard * 0.45)
    if not a.body or not b.body:
        return round(title, 6)
    contained, jaccard, _ = _share(a.bt, b.bt)
    return round(min(1.0, title * 0.78 + max(contained * 0.55 + jaccard * 0.45, _share(a.bg, b.bg)[2]) * 0.22), 6)


def _full(a: Article, b: Article) -> float:
    from difflib import SequenceMatcher

    return lexical(a, b, SequenceMatcher(None, a.tc, b.tc).ratio() if a.t and b.t and a.tc != b.tc else 0.0)


def match(a: Article, b: Article, lex: float) -> float | None:
    """The score of a pair that tells one event, else None."""
    shared = a.concepts.keys() & b.concepts.keys()
    weight, high = sum(min(a.concepts[k], b.concepts[k]) for k in shared), sum(k.startswith(HIGH) for k in shared)
    hours = abs(a.at - b.at) / 3600
    if hours > FOLLOW_UP:
        return None
    if a.tc and a.tc == b.tc:
        return 1.0
    if hours <= RECENT:
        matched = lex >= 0.66 or (lex >= 0.43 and high >= 1 and weight >= 1.8) or (lex >= 0.30 and high >= 2 and weight >= 3.0)
    else:
        matched = lex >= 0.78
    return round(min(1.0, 0.60 * lex + 0.10 * min(1.0, weight / 5)), 6) if matched else None


def best_match(article: Article, recent: list[Article]) -> tuple[Article, float] | None:
    """Of the recent articles, newest first, the COMPARED ones with the highest similarity
    and shared concepts may match; the best score wins, then the higher similarity, then
    the newer. A cheap bound of the similarity orders them, so that the sequence ratio is
    taken only of those that can still be among the compared."""
    import heapq

    bonus = lambda b: min(0.15, 0.025 * len(article.concepts.keys() & b.concepts.keys()))
    bounds = sorted(((lexical(article, b, 1.0) + bonus(b), -i, b) for i, b in enumerate(recent)), key=lambda x: (-x[0], -x[1]))
    top: list[tuple[float, int, float, Article]] = []
    for bound, place, b in bounds:
        if len(top) == COMPARED and bound < top[0][0]:
            break
        lex = _full(article, b)
        entry = (lex + bonus(b), place, lex, b)
        if len(top) < COMPARED:
            heapq.heappush(top, entry)
        elif entry[:2] > top[0][:2]:
            heapq.heapreplace(top, entry)
    best = None
    for _, place, lex, b in sorted(top, key=lambda x: (-x[0], -x[1])):
        score = match(article, b, lex)
        if score is not None and (best is None or score > best[1]):
            best = (b, score)
    return best


class Recent:
    """A company's articles of the last FOLLOW_UP hours, CANDIDATES at most, in order."""

    def __init__(self, articles=()):
        self.held: deque[Article] = deque(articles, CANDIDATES)

    def before(self, article: Article) -> list[Article]:
        """Those that `article` may join, newest first; older ones are forgotten."""
        while self.held and article.at - self.held[0].at > FOLLOW_UP * 3600:
            self.held.popleft()
        return list(reversed(self.held))

    def add(self, article: Article) -> None:
        self.held.append(article)


def ready(rows: DataFrame) -> DataFrame:
    """Items with what matching needs; the fingerprint is what a story is called that they found."""
    day = F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd")
    material = F.concat(F.lit("story-cluster-v2|"), F.array_join(F.array_sort("tt"), " "), F.lit("|"), day)
    names = [f.strip().split(" ")[0] for f in FIELDS.split(", ")]
    return prepared(rows).withColumns({"fingerprint": F.sha2(material, 256), "at": F.col("at").cast("long")}).where("at IS NOT NULL AND raw_id IS NOT NULL").select(*names)


def _first_of(items, at, one: int, recent, row: dict):
    """What `best_match` finds for the item at place `one` among those at places `recent`, newest
    first, given the row of `Titles.shared` between them: its place and the score, or None. Only
    items whose bound could match, and beat the best so far, are looked at, likely ones first;
    that one is among the COMPARED is counted, by exact numbers only where bounds do not tell.
    A generator: it asks for sequence ratios, (places, ratios below which they tell nothing),
    and is sent them, so that many items' are taken at once."""
    import numpy as np

    near = at[one] - at[recent] <= FOLLOW_UP * 3600
    recent, row = recent[near], {k: m[near] for k, m in row.items()}
    parts = items.parts(one, recent, row)
    fixed, jaccard, body, no_body = parts
    same, bare = items.same[recent] == items.same[one], items.empty_title[one] | items.empty_title[recent]
    exact = same & (items.length[one] > 0)
    has = items.has[recent] & items.has[one]
    bonus, weight, hours = np.minimum(0.15, 0.025 * has.sum(axis=1)), np.where(has, np.minimum(items.weights[recent], items.weights[one]), 0.0).sum(axis=1), np.abs(at[one] - at[recent]) / 3600
    high = (has & items.strong).sum(axis=1)
    need = np.where(hours > RECENT, 0.78, np.where((high >= 2) & (weight >= 3.0), 0.30, np.where((high >= 1) & (weight >= 1.8), 0.43, 0.66)))
    extra = 0.10 * np.minimum(1.0, weight / 5)
    known, value = same | bare, np.where(bare, 0.0, 1.0)  # similarities, where they are known
    limits = items.upper_ratio(one, recent)
    upper = np.where(bare, 0.0, np.where(same, 1.0, items.whole(parts, limits) + 1e-6))
    low = np.where(same, 1.0, items.whole(parts, 0.0))  # an order to look at them
    most = lambda js: np.where(exact[js], 1.0, np.minimum(1.0, 0.60 * upper[js] + extra[js]) + 1e-6)

    def bound(js, ratios):
        limits[js] = np.minimum(limits[js], ratios)
        whole = items.whole([p[js] for p in parts], limits[js])
        upper[js] = np.minimum(upper[js], whole + 1e-6)
        return whole

    def tighten(js):
        js = js[~known[js]]
        bound(js, items.upper_ratio(one, recent[js], close=True))

    def look(js, floor):
        """The similarities of js become known, but where they are below `floor`."""
        open_ = ~known[js]
        js, floor = js[open_], floor[open_]
        least = (np.maximum(np.where(no_body[js], floor, (floor - body[js] * 0.22) / 0.78), fixed[js]) - jaccard[js] * 0.45) / 0.55 - 1e-6
        ask = (limits[js] >= least) & (fixed[js] < limits[js] * 0.55 + jaccard[js] * 0.45)
        ratios = limits[js].copy()
        if ask.any():
            ratios[ask] = yield recent[js[ask]], least[ask]
        whole = bound(js, ratios)
        told = (ask & (ratios >= least)) | (fixed[js] >= limits[js] * 0.55 + jaccard[js] * 0.45)
        known[js[told]], value[js[told]] = True, [round(x, 6) for x in whole[told].tolist()]

    def compared(j):
        mine = float(value[j] + bonus[j])
        rivals = np.flatnonzero((upper + bonus >= mine) & (np.arange(len(upper)) != j))
        if len(rivals) >= COMPARED:
            tighten(rivals)
            rivals = rivals[(upper + bonus)[rivals] >= mine]
        ahead, rivals = 0, rivals[np.argsort(-low[rivals], kind="stable")]
        while ahead < COMPARED <= ahead + len(rivals):
            now, rivals = rivals[:COMPARED], rivals[COMPARED:]
            yield from look(now, mine - bonus[now] - 2e-6)
            keys = value[now] + bonus[now]
            ahead += int((known[now] & ((keys > mine) | ((keys == mine) & (now < j)))).sum())
        return ahead < COMPARED

    may = np.flatnonzero(exact | (upper >= need))
    tighten(may)
    may = may[exact[may] | (upper[may] >= need[may])]
    may, best, size = may[np.argsort(-np.where(exact[may], 2.0, low[may]), kind="stable")], None, 4
    while len(may):
        if best is not None:
            may = may[most(may) >= best[0][0]]
        now, may, size = may[:size], may[size:], size * 4
        yield from look(now, np.maximum(need[now], -1.0 if best is None else (best[0][0] - extra[now]) / 0.60) - 3e-6)
        for j in now.tolist():
            if exact[j]:
                score = 1.0
            elif known[j] and value[j] >= need[j]:
                score = round(min(1.0, 0.60 * float(value[j]) + 0.10 * min(1.0, float(weight[j]) / 5)), 6)
            else:
                continue
            rank = (score, float(value[j] + bonus[j]), -j)
            if (best is None or rank > best[0]) and (yield from compared(j)):
                best = (rank, j)
    return best and (int(recent[best[1]]), best[0][0])


def _all_first(items, runs: dict) -> dict:
    """What each of the runs of `_first_of` finds, by item; ratios are taken for all at once."""
    import numpy as np

    found, answers = {}, dict.fromkeys(runs)
    while answers:
        asked = {}
        for one, answer in answers.items():
            try:
                asked[one] = runs[one].send(answer)
            except StopIteration as end:
                found[one] = end.value
        if asked:
            sizes = [len(places) for places, _ in asked.values()]
            places, least = (np.concatenate(x) for x in zip(*asked.values()))
            ratios = items.ratios(np.repeat(np.array(list(asked)), sizes), places, least)
            answers = dict(zip(asked, np.split(ratios, np.cumsum(sizes)[:-1])))
        else:
            answers = {}
    return found


def _joined(batches):
    """Rows of blocks of a company, each block's together with the one before, to `parents`."""
    import numpy as np
    import pyarrow as pa

    from tidewatch.functions.batches import by_key
    from tidewatch.functions.likeness import Titles

    step = 256

    def told(rows):
        rows.sort(key=lambda r: r["position"])
        asked = sum(not r["asks"] for r in rows)  # those of the block before come first
        concepts = [{c["key"]: c["weight"] for c in r["concepts"]} for r in rows]
        keys = sorted({k for c in concepts for k in c})
        items = Titles([(r["t"], r["body"]) for r in rows], concepts, frozenset(STOP_TOKENS), keys)
        items.strong = np.array([k.startswith(HIGH) for k in keys], bool)
        at = np.array([r["at"] for r in rows], np.int64)
        for start in range(asked, len(rows), step):
            part = slice(start, min(start + step, len(rows)))
            before = slice(max(0, start - CANDIDATES), part.stop)
            both, runs = items.shared(part, before), {}
            for i in range(part.start, part.stop):
                first = max(before.start, i - CANDIDATES)
                recent = np.arange(i - 1, first - 1, -1)
                runs[i] = _first_of(items, at, i, recent, {k: m[i - part.start, recent - before.start] for k, m in both.items()})
            out = []
            for i, found in sorted(_all_first(items, runs).items()):
                out.append((rows[i]["raw_id"], rows[i]["fingerprint"], found and rows[found[0]]["raw_id"], found[1] if found else 1.0))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["raw_id", "fingerprint", "parent", "similarity"])

    yield from by_key(batches, ["company_id", "block"], told)


def parents(rows: DataFrame) -> DataFrame:
    """(raw_id, fingerprint, parent, similarity): of each of `ready`'s articles the earlier one
    that it joins, null where it founds a story. A company's articles in order are cut into
    blocks of CANDIDATES, which go to the next block too, as what may be joined there; so a
    company's history is split, and a task holds two blocks. It compares by arrays and takes the
    sequence ratio, of many pairs at once, only of what can still be the best match."""
    light = written(rows.select("company_id", "raw_id", "at", "fingerprint", "t", "body", "concepts"))  # read twice
    placed = with_positions(light, ["company_id"], [F.col("at"), F.col("raw_id")])
    own = placed.withColumns({"block": F.floor(F.col("position") / CANDIDATES), "asks": F.lit(True)})
    own = written(own)
    both = own.unionByName(own.withColumns({"block": F.col("block") + 1, "asks": F.lit(False)}))
    blocks = own.select("company_id", "block").distinct().count()
    tasks = max(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # fixed, as the work is large for the bytes
    dealt = both.repartition(tasks, "company_id", "block").sortWithinPartitions("company_id", "block")
    return dealt.mapInArrow(_joined, "raw_id long, fingerprint string, parent long, similarity double")


def assigned(rows: DataFrame) -> DataFrame:
    """(raw_id, story, similarity, representative) of `ready`'s articles: all as they would be
    assigned one by one. A story is called by its founder's fingerprint; founders that share
    one share the story. Chains are followed by pointer jumps, twice as far each round."""
    links = written(parents(rows))
    ends = written(links.select("raw_id", F.coalesce("parent", "raw_id").alias("end")))
    while True:
        up = ends.select(F.col("raw_id").alias("end"), F.col("end").alias("further"))
        jumped = written(ends.join(up, "end").select("raw_id", F.col("further").alias("end"), (F.col("further") != F.col("end")).alias("moved")))
        discard(ends)
        moved, ends = not jumped.where("moved").isEmpty(), jumped
        if not moved:
            break
        ends = jumped.select("raw_id", "end")
        ends.written_to = jumped.written_to
    named = links.select(F.col("raw_id").alias("end"), F.col("fingerprint").alias("story"))
    found = ends.select("raw_id", "end").join(named, "end").select("raw_id", "story")
    return links.join(found, "raw_id").select("raw_id", "story", "similarity", F.col("parent").isNull().alias("representative"))


def stories_as_they_come(rows: DataFrame) -> DataFrame:
    """The streaming twin over `ready`'s articles: (raw_id, story, similarity, representative) of
    each article of a batch, in order of time and id. State is what `Recent` holds of a
    company, with the stories; what is older than FOLLOW_UP hours goes, and so does what is
    beyond CANDIDATES. An article that comes late joins what came before it and is near in time."""
    from pyspark.sql.streaming import StatefulProcessor
    from pyspark.sql.types import StructType

    state_schema = StructType.fromDDL("at long, raw_id long, article string")

    class Assign(StatefulProcessor):
        def init(self, handle) -> None:
            self.held = handle.getListState("recent", state_schema)

        def handleInputRows(self, key, rows, timers):
            import json

            import pandas as pd

            kept = [(x[0], x[1], json.loads(x[2])) for x in self.held.get()] if self.held.exists() else []
            recent = Recent()
            raw = {}
            for _, raw_id, row in kept:
                article = Article.of(row)
                article.story = row["story"]
                recent.add(article)
                raw[raw_id] = row
            new = sorted((json.loads(x) for frame in rows for x in frame["article"]), key=lambda r: (r["at"], r["raw_id"]))
            out = []
            for row in new:
                article = Article.of(row)
                best = best_match(article, recent.before(article))
                article.story = row["story"] = best[0].story if best else article.fingerprint
                recent.add(article)
                raw[article.raw_id] = row
                out.append((article.raw_id, article.story, best[1] if best else 1.0, best is None))
            self.held.put([(a.at, a.raw_id, json.dumps(raw[a.raw_id])) for a in recent.held])
            yield pd.DataFrame(out, columns=["raw_id", "story", "similarity", "representative"])

        def close(self) -> None:
            pass

    packed = rows.select("company_id", F.to_json(F.struct(*[c for c in rows.columns if c != "company_id"])).alias("article"))
    return packed.groupBy("company_id").transformWithStateInPandas(Assign(), "raw_id long, story string, similarity double, representative boolean", outputMode="Append", timeMode="None")


def story_assignments(spark, sf_dir):
    """Each item's story, as if items had come one by one: how similar it is to the item it
    joined, and whether it founded the story."""
    return assigned(ready(items(spark, sf_dir)))


QUERIES = {"story_assignments": story_assignments}
ORACLE_SQL: dict[str, str] = {}
