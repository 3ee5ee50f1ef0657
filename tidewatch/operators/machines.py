"""Lifecycles as state machines over logs: drafts of responses, and story events under human
protection. Logs are made of the articles, a company's or a story's in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.machine import folded, folded_sql, machine_of
from tidewatch.sources.tables import table

#: A draft: evidence asks for it, or puts it off where drafts are not made automatically; a
#: person may ask or force; a job starts and ends it; a restart asks again for what was
#: under way; closing an event drops what waits, withdrawing it drops all.
DRAFTS = machine_of(
    "idle pending generating generated failed deferred not_applicable",
    {
        "evidence": {"*": "pending"}, "evidence_unasked": {"*": "deferred"}, "force": {"*": "pending"},
        "request": {"*": "pending", "pending generating generated": "="}, "start": {"pending": "generating"},
        "finish": {"generating": "generated"}, "nothing_to_do": {"generating": "not_applicable"}, "fail": {"generating": "failed"},
        "restart": {"*": "=", "pending generating": "pending"}, "close": {"*": "=", "pending generating deferred": "idle"}, "withdraw": {"*": "idle"},
    },
)
#: A story event: a story that qualifies opens it, or brings it back if its evidence is recent;
#: one that no longer does withdraws it; quiet days close it. What a person has confirmed (a state
#: with `!`) or dismissed, no run touches until the person lets it go.
_FREE, _HELD = "open monitoring closed withdrawn", "open! monitoring! closed! withdrawn!"
EVENTS = machine_of(
    f"none {_FREE} {_HELD} dismissed",
    {
        "qualify": {"*": "=", "none": "open", "closed withdrawn": "monitoring"}, "qualify_old": {"*": "=", "none": "open", "withdrawn": "monitoring"},
        "disqualify": {"*": "=", "open monitoring closed": "withdrawn"}, "quiet": {"*": "=", "open monitoring": "closed"},
        "confirm": {**{s: f"{s}!" for s in _FREE.split()}, _HELD: "="}, "release": {**{f"{s}!": s for s in _FREE.split()}, "dismissed": "withdrawn"},
        "dismiss": {f"{_FREE} {_HELD}": "dismissed"},
    },
)
BY_RUNS = ("qualify", "qualify_old", "disqualify", "quiet")

_DRAFT_ACTION = """CASE WHEN event_id % 23 = 0 THEN 'withdraw' WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'evidence_unasked' ELSE 'evidence' END WHEN event_type = 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'force' ELSE 'request' END
  WHEN event_type = 'view' THEN 'start' WHEN event_type = 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'nothing_to_do' ELSE 'finish' END WHEN event_id % 3 = 0 THEN 'fail' WHEN event_id % 3 = 1 THEN 'restart' ELSE 'close' END"""
_EVENT_ACTION = """CASE WHEN event_id % 13 = 0 THEN 'confirm' WHEN event_id % 29 = 0 THEN 'dismiss' WHEN event_id % 7 = 0 THEN 'release' WHEN value >= 200 THEN CASE WHEN event_id % 2 = 0 THEN 'qualify' ELSE 'qualify_old' END WHEN value >= 100 THEN 'quiet' ELSE 'disqualify' END"""
_STORY = "concat(CAST(user_id % 50 AS STRING), '/', get_json_object(props, '$.k'))"
_STORY_SQL = "(user_id % 50) || '/' || (props->>'$.k')"


def _log(spark, sf_dir, key: str, action: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("day"), F.expr(key).alias("log_key"), F.expr(action).alias("action"))


def _drafts(spark, sf_dir) -> DataFrame:
    return folded(_log(spark, sf_dir, "CAST(user_id % 50 AS STRING)", _DRAFT_ACTION), DRAFTS, ["log_key"], "day", ["ts", "event_id"])


def _events(spark, sf_dir) -> DataFrame:
    return folded(_log(spark, sf_dir, _STORY, _EVENT_ACTION), EVENTS, ["log_key"], "day", ["ts", "event_id"])


def draft_log(spark, sf_dir):
    """Every transition of a company's draft: the state before, the action, the state after,
    and whether the action was allowed."""
    return _drafts(spark, sf_dir).select("event_id", F.col("log_key").alias("company"), "action", "before", "after", "legal")


def draft_states(spark, sf_dir):
    """Where each company's draft stands, how often it was made and failed, and how many
    actions were not allowed."""
    last = F.max_by("after", F.struct("ts", "event_id"))
    moved = F.col("before") != F.col("after")
    return _drafts(spark, sf_dir).groupBy(F.col("log_key").alias("company")).agg(
        last.alias("state"), F.count(F.lit(1)).alias("actions"), F.count_if(~F.col("legal")).alias("illegal"), F.count_if(moved & (F.col("after") == "generated")).alias("made"), F.count_if(moved & (F.col("after") == "failed")).alias("failed"),
    )


def story_event_log(spark, sf_dir):
    """Every action on a story's event and what it did; `protected` where a run met an event
    that a person has decided on."""
    held = F.col("action").isin(*BY_RUNS) & (F.col("before").endswith("!") | (F.col("before") == "dismissed"))
    return _events(spark, sf_dir).select("event_id", F.col("log_key").alias("story"), "action", "before", "after", "legal", held.alias("protected"))


def story_event_totals(spark, sf_dir):
    """Per day the events opened, brought back, withdrawn, closed and dismissed, and those a
    run had to leave alone."""
    rows = story_event_log(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day")), "event_id")
    moved = lambda to: F.count_if((F.col("before") != F.col("after")) & (F.col("after") == to))
    return rows.groupBy("day").agg(moved("open").alias("opened"), moved("monitoring").alias("brought_back"), moved("withdrawn").alias("withdrawn"), moved("closed").alias("closed"), moved("dismissed").alias("dismissed"), F.count_if("protected").alias("protected"))


QUERIES = {f.__name__: f for f in (draft_log, draft_states, story_event_log, story_event_totals)}

_DRAFTS_SQL = f"log AS (SELECT event_id, ts, CAST(user_id % 50 AS VARCHAR) AS log_key, {_DRAFT_ACTION} AS action FROM events), {folded_sql('log', DRAFTS, 'log_key', 'ts, event_id', 'n.event_id, n.ts, n.log_key, n.action')}"
_EVENTS_SQL = f"log AS (SELECT event_id, ts, {_STORY_SQL} AS log_key, {_EVENT_ACTION} AS action FROM events), {folded_sql('log', EVENTS, 'log_key', 'ts, event_id', 'n.event_id, n.ts, n.log_key, n.action')}"
_RUNS_SQL = ", ".join(f"'{a}'" for a in BY_RUNS)
_HELD_SQL = f"(action IN ({_RUNS_SQL}) AND (ends_with(before, '!') OR before = 'dismissed'))"
ORACLE_SQL = {
    "draft_log": f"WITH RECURSIVE {_DRAFTS_SQL} SELECT event_id, log_key AS company, action, before, after, legal FROM folded",
    "draft_states": f"""WITH RECURSIVE {_DRAFTS_SQL} SELECT log_key AS company, arg_max(after, struct_pack(a := ts, b := event_id)) AS state, count(*) AS actions, count(*) FILTER (WHERE NOT legal) AS illegal,
      count(*) FILTER (WHERE before <> after AND after = 'generated') AS made, count(*) FILTER (WHERE before <> after AND after = 'failed') AS failed FROM folded GROUP BY log_key""",
    "story_event_log": f"WITH RECURSIVE {_EVENTS_SQL} SELECT event_id, log_key AS story, action, before, after, legal, {_HELD_SQL} AS protected FROM folded",
    "story_event_totals": f"""WITH RECURSIVE {_EVENTS_SQL} SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE before <> after AND after = 'open') AS opened, count(*) FILTER (WHERE before <> after AND after = 'monitoring') AS brought_back, count(*) FILTER (WHERE before <> after AND after = 'withdrawn') AS withdrawn,
      count(*) FILTER (WHERE before <> after AND after = 'closed') AS closed, count(*) FILTER (WHERE before <> after AND after = 'dismissed') AS dismissed, count(*) FILTER (WHERE {_HELD_SQL}) AS protected FROM folded GROUP BY ALL""",
}
