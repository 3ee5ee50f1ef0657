"""State machines over logs against a plain fold, and the rules of the two lifecycles."""

import random

import pytest

from tidewatch.functions.machine import Machine, folded, machine_of
from tidewatch.operators.machines import DRAFTS, EVENTS

LOG = "k string, day int, n int, action string, `before x` int"


def plain(rows, machine):
    state, out = {}, []
    for k, day, n, action, x in sorted(rows, key=lambda r: (r[1], r[2])):
        before = state.get(k, machine.states[0])
        after = machine.moves.get((before, action))
        state[k] = after or before
        out.append((k, day, n, action, x, before, state[k], after is not None))
    return out


@pytest.mark.parametrize("machine", [DRAFTS, EVENTS])
def test_fold_against_plain(spark, machine):
    """A hot key over many chunks, null keys and actions, unknown actions."""
    draw = random.Random(4)
    rows = [(draw.choice(["hot", "hot", "hot", "a", None]), draw.randrange(9), i, draw.choice([*machine.actions, None, "unknown"]), i) for i in range(900)]
    got = folded(spark.createDataFrame(rows, LOG).repartition(6), machine, ["k"], "day", ["n"])
    assert got.columns == ["k", "day", "n", "action", "before x", "before", "after", "legal"]
    tell = lambda x: sorted((tuple(r) for r in x), key=repr)
    assert tell(got.collect()) == tell(plain(rows, machine))


def test_no_log(spark):
    assert folded(spark.createDataFrame([], LOG), DRAFTS, ["k"], "day", ["n"]).collect() == []


def walk(machine, actions):
    state, told = machine.states[0], []
    for a in actions.split():
        to = machine.moves.get((state, a))
        told.append(to or f"({state})")
        state = to or state
    return " ".join(told)


def test_drafts():
    assert walk(DRAFTS, "evidence start finish request force start fail request") == "pending generating generated generated pending generating failed pending"
    assert walk(DRAFTS, "start finish fail") == "(idle) (idle) (idle)"
    assert walk(DRAFTS, "evidence start restart start nothing_to_do close evidence_unasked close") == "pending generating pending generating not_applicable not_applicable deferred idle"
    assert walk(DRAFTS, "evidence start finish withdraw evidence") == "pending generating generated idle pending"


def test_events_under_protection():
    """Reopened with recent evidence only; what a person confirmed or dismissed stays."""
    assert walk(EVENTS, "qualify quiet qualify_old qualify disqualify qualify_old") == "open closed closed monitoring withdrawn monitoring"
    assert walk(EVENTS, "qualify confirm disqualify quiet qualify release quiet") == "open open! open! open! open! open closed"
    assert walk(EVENTS, "qualify quiet confirm qualify release qualify") == "open closed closed! closed! closed monitoring"
    assert walk(EVENTS, "qualify dismiss qualify disqualify confirm release qualify") == "open dismissed dismissed dismissed (dismissed) withdrawn monitoring"
    assert walk(EVENTS, "quiet confirm dismiss") == "none (none) (none)"


def test_unknown_names_are_refused():
    with pytest.raises(ValueError):
        Machine(("a",), ("go",), {("a", "go"): "b"})
    assert machine_of("a b", {"go": {"*": "b", "b": "="}}).moves == {("a", "go"): "b", ("b", "go"): "b"}
