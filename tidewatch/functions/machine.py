"""State machines folded over ordered logs, and the same in SQL.

What a run of actions does to a state is a map of states, and maps of one run after another
compose. So a key's log is cut into chunks that are folded side by side: first each chunk's
map, then the states that chunks start from, over a few maps a key, then each chunk again
from its start. However hot a key is, a task sees a chunk of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


@dataclass(frozen=True)
class Machine:
    """`moves` maps (state, action) to the state after; what it lacks is illegal and leaves
    the state as it is. States are listed with the start first."""

    states: tuple[str, ...]
    actions: tuple[str, ...]
    moves: dict[tuple[str, str], str]

    def __post_init__(self):
        unknown = [m for m in [*self.moves, *((s, self.actions[0]) for s in self.moves.values())] if m[0] not in self.states or m[1] not in self.actions]
        if unknown:
            raise ValueError(f"moves with unknown states or actions: {unknown}")

    def table(self) -> list[list[int]]:
        """For each action and state the state after, -1 where illegal."""
        at = {s: i for i, s in enumerate(self.states)}
        return [[at.get(self.moves.get((s, a), ""), -1) for s in self.states] for a in self.actions]


def machine_of(states: str, moves: dict[str, dict[str, str]]) -> Machine:
    """A machine from 'first second ..' and {action: {'state state ..': state after}}; `*`
    stands for all states, `=` for the state itself, and later entries win."""
    names = tuple(states.split())
    found = {}
    for action, of in moves.items():
        for before, after in of.items():
            for s in names if before == "*" else before.split():
                found[s, action] = s if after == "=" else after
    return Machine(names, tuple(moves), found)


def folded(log: DataFrame, machine: Machine, key: list[str], chunk: str, order: list[str], action: str = "action") -> DataFrame:
    """The log with `before`, `after` and `legal` of each row. A key's rows stand in order of
    `chunk`, then of `order`, which must tell rows apart. Null and unknown actions are
    illegal. Rows with a null key are a log of their own; repeated rows are actions repeated."""
    table, width, own = machine.table(), len(machine.states), len(log.columns)
    code = F.coalesce(F.array_position(F.array(*map(F.lit, machine.actions)), F.col(action)), F.lit(0)).cast("int") - 1
    rows = log.withColumn("_code", code)
    places = [rows.columns.index(c) for c in (*key, chunk)]
    keys = StructType([rows.schema[c] for c in (*key, chunk)])
    dealt = lambda df: df.repartition(*key, chunk).sortWithinPartitions(*key, chunk, *order)

    def maps(batches):
        import pyarrow as pa

        now, state, head = None, [], None
        for batch in batches:
            out = []
            for values in zip(*[batch.column(p).to_pylist() for p in places], batch.column("_code").to_pylist()):
                if now is None or values[:-1] != head:
                    if now is not None:
                        out.append((*head, state))
                    now, head, state = True, values[:-1], list(range(width))
                if values[-1] >= 0:
                    step = table[values[-1]]
                    state = [step[s] if step[s] >= 0 else s for s in state]
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in out], schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (*head, state)))], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    map_schema = StructType([*keys.fields, *StructType.fromDDL("_map array<int>").fields])
    arrow = to_arrow_schema(map_schema)
    chunks = dealt(rows).mapInArrow(maps, map_schema)
    listed = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(chunk).alias("chunk"), "_map"))).alias("list"))
    starts = F.aggregate("list", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(x["_map"], F.element_at(acc, -1) + 1))))
    each = listed.select(*key, F.posexplode("list").alias("at", "x"), starts.alias("starts"))
    begun = each.select(*[F.col(k).alias(f"_of_{k}") for k in key], F.col("x.chunk").alias("_of_chunk"), F.element_at("starts", F.col("at") + 1).alias("_start"))
    met = F.col(chunk).eqNullSafe(F.col("_of_chunk"))
    for k in key:
        met &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    ready = rows.join(begun, met).select(*rows.columns, "_start")
    names = machine.states
    result = StructType([*log.schema.fields, *StructType.fromDDL("before string, after string, legal boolean").fields])
    result = StructType([StructField(f.name, f.dataType, True) for f in result.fields])

    def walk(batches):
        import pyarrow as pa

        head, state = None, 0
        for batch in batches:
            before, after, legal = [], [], []
            for values in zip(*[batch.column(p).to_pylist() for p in places], batch.column("_code").to_pylist(), batch.column("_start").to_pylist()):
                if head is None or values[:-2] != head:
                    head, state = values[:-2], values[-1]
                to = table[values[-2]][state] if values[-2] >= 0 else -1
                before.append(names[state])
                legal.append(to >= 0)
                state = to if to >= 0 else state
                after.append(names[state])
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(legal, pa.bool_())], names=result.names)

    return dealt(ready).mapInArrow(walk, result)


def folded_sql(log: str, machine: Machine, key: str, order: str, columns: str) -> str:
    """CTEs that end in `folded`: the columns of table `log` named, key, before, after and legal."""
    moves = ", ".join(f"('{s}', '{a}', '{t}')" for (s, a), t in machine.moves.items())
    return f"""moves(state, act, next_state) AS (VALUES {moves}), numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS step FROM {log}),
      walked AS (SELECT {key}, CAST(0 AS BIGINT) AS step, '{machine.states[0]}' AS before, '{machine.states[0]}' AS after, true AS legal FROM (SELECT DISTINCT {key} FROM numbered)
        UNION ALL SELECT w.{key}, n.step, w.after, coalesce(m.next_state, w.after), m.next_state IS NOT NULL FROM walked w JOIN numbered n ON n.{key} IS NOT DISTINCT FROM w.{key} AND n.step = w.step + 1 LEFT JOIN moves m ON m.state = w.after AND m.act = n.action),
      folded AS (SELECT {columns}, w.before, w.after, w.legal FROM walked w JOIN numbered n ON n.{key} IS NOT DISTINCT FROM w.{key} AND n.step = w.step)"""
