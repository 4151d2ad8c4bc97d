"""Chat formatting by minimum-cost role repair.

Legal: an optional system turn, then user and assistant turns by turns, ending with an
assistant's. A turn may be kept, merged into the turn before it, relabelled, or preceded by
empty turns; dynamic programming over the automaton finds the cheapest repair. One turn is a
4 x 4 matrix of costs from state to state, and matrices compose (least sums), so a
conversation of any length is cut into blocks that are composed level by level, and the
cheapest path is then traced back down. No task holds more than BLOCK turns' worth of rows of
one conversation, and rendered turns are returned row by row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BLOCK_BITS = 12
#: Costs of a merge, of a new role, of an empty turn put in.
MERGE, RELABEL, INSERT = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
FOLLOW = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
NEVER = 1 << 40


def role_of(name: str | None) -> int:
    """A state's number; 0 for a role that is not known (or null), which every label costs RELABEL."""
    return ALIASES.get((name or "").strip().lower(), 0)


def _inserts(state: int, role: int) -> tuple[int, ...]:
    """The fewest empty turns after `state` before a turn of `role`; a system turn can only be first."""
    ways = [(state, ())]
    while ways:
        now, path = ways.pop(0)
        if role in FOLLOW[now]:
            return path
        if len(path) < 3:
            ways += [(n, (*path, n)) for n in FOLLOW[now] if n != SYSTEM]
    return (-1,)


def _steps(role: int) -> list[list[tuple[int, str, tuple[int, ...]]]]:
    """From state, to state: cost, action, empty turns before. Of equal costs, the first action in the order tried stays."""
    table = []
    for state in range(4):
        row = [(NEVER, "", ())] * 4
        for to in (SYSTEM, USER, ASSISTANT):
            tried = []
            if (ins := _inserts(state, to)) != (-1,):
                tried.append((INSERT * len(ins) + RELABEL * (to != role), "keep" if to == role else "relabel", ins))
            if to == state:
                tried.append((MERGE + RELABEL * (to != role), "merge" if to == role else "relabel_merge", ()))
            row[to] = min(tried, default=row[to], key=lambda x: x[0])
        table.append(row)
    return table


STEPS = [_steps(r) for r in range(4)]
COSTS = [[[c for c, _, _ in row] for row in table] for table in STEPS]
#: Empty turns needed at the end, by state.
ENDING = ((), (USER, ASSISTANT), (ASSISTANT,), ())


def compose(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[min(min(row[k] + b[k][j] for k in range(4)), NEVER) for j in range(4)] for row in a]


def trace(matrices: list[list[list[int]]], first: int, last: int) -> list[int]:
    """The states after each matrix of a cheapest path from state `first` to state `last`; of equal ones, the lowest state."""
    cost = [0 if s == first else NEVER for s in range(4)]
    back = []
    for m in matrices:
        came = [min(range(4), key=lambda s: (cost[s] + m[s][j], s)) for j in range(4)]
        cost = [min(cost[came[j]] + m[came[j]][j], NEVER) for j in range(4)]
        back.append(came)
    path = [last]
    for came in reversed(back[1:]):
        path.append(came[path[-1]])
    return path[::-1]


def final_state(matrix: list[list[int]]) -> int:
    return min((SYSTEM, USER, ASSISTANT), key=lambda s: (matrix[START][s] + INSERT * len(ENDING[s]), -s))


def _flat(m: list[list[int]]) -> list[int]:
    return [x for row in m for x in row]


def _square(v) -> list[list[int]]:
    v = [int(x) for x in v]
    return [v[i : i + 4] for i in (0, 4, 8, 12)]


def _runs(keys: list) -> Iterator[tuple[int, int]]:
    a = 0
    for b in range(1, len(keys) + 1):
        if b == len(keys) or keys[b] != keys[a]:
            yield a, b
            a = b


def frame(action: str, before: tuple[int, ...], role: int, after: tuple[int, ...]) -> tuple[str, str]:
    """What stands before and after a row's text in the rendered conversation."""
    empty = lambda roles: "".join(f"<|{ROLES[r]}|>\n\n" for r in roles)
    return empty(before) + ("" if action.endswith("merge") else f"<|{ROLES[role]}|>\n"), "\n" + empty(after)


def escaped(text: Column) -> Column:
    """No text can look like the start of a turn: < and | get a backslash between them, one more where there are some. unescape() takes it away."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(rendered: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", rendered)


def repair_roles(turns: DataFrame) -> DataFrame:
    """One row per turn, in the order of `at` within a conversation: what became of it, and its rendered part.

    Turns are ordered by turn (null first), role, text; equal rows in any order. Null text counts as
    empty, a null or unknown role must be relabelled, rows of a null conv_id form one conversation.
    Empty table: no rows. `cost` is the row's own; a last row's includes empty turns after it.
    Rendered parts joined in order are the rendered conversation. Whole texts, however long, stay in
    Spark's own rows: Python sees roles only.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    slim = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "_tie", "_salt"]
    ordered = slim.withColumn("_tie", F.col("text")).withColumn("_salt", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie", "_salt").withColumn("at", F.monotonically_increasing_id())
    ordered = scratch.keep(ordered, "ordered").withColumn("_block", F.expr(f"shiftright(at, {BLOCK_BITS})"))

    def block_matrices(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        convs, roles, out = rows["_conv"].tolist(), [role_of(r) for r in rows["role"]], []
        for a, b in _runs(convs):
            m = COSTS[roles[a]]
            for r in roles[a + 1 : b]:
                m = compose(m, COSTS[r])
            out.append((convs[a], int(rows["_block"].iloc[0]), _flat(m)))
        return pd.DataFrame(out, columns=["_conv", "pos", "m"])

    conv = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("null"))
    level = "_conv string, pos long, m array<long>"
    segments = [scratch.keep(ordered.select(conv.alias("_conv"), "role", "at", "_block").groupBy("_block").applyInPandas(block_matrices, level), "level-0")]

    def compose_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        m = _square(rows["m"].iloc[0])
        for v in rows["m"].iloc[1:]:
            m = compose(m, _square(v))
        return pd.DataFrame({"_conv": [rows["_conv"].iloc[0]], "pos": [int(rows["pos"].iloc[0]) >> BLOCK_BITS], "m": [_flat(m)]})

    # Level by level: only conversations that still have several segments go on; the others are solved at their level.
    tops = []
    while True:
        counted = segments[-1].groupBy("_conv").count()
        many = scratch.keep(counted.where("count > 1").select("_conv"), f"many-{len(segments)}")
        tops.append(segments[-1].join(many, "_conv", "left_anti"))
        if many.isEmpty():
            break
        higher = segments[-1].join(many, "_conv", "left_semi").withColumn("_up", F.expr(f"shiftright(pos, {BLOCK_BITS})")).groupBy("_conv", "_up").applyInPandas(lambda rows: compose_group(rows.drop(columns="_up")), level)
        segments.append(scratch.keep(higher, f"level-{len(segments)}"))

    @F.pandas_udf("int")
    def ends_in(m: pd.Series) -> pd.Series:
        return m.map(lambda v: final_state(_square(v))).astype("int32")

    path = "_conv string, pos long, enters int, leaves int, is_last boolean"
    solved = None
    for k in range(len(segments) - 1, -1, -1):
        top = tops[k].select("_conv", "pos", F.lit(START).alias("enters"), ends_in("m").alias("leaves"), F.lit(True).alias("is_last"))
        if solved is not None:

            def descend(rows: pd.DataFrame) -> pd.DataFrame:
                rows = rows.sort_values("pos")
                first, last = int(rows["enters"].iloc[0]), int(rows["leaves"].iloc[0])
                states = trace([_square(v) for v in rows["m"]], first, last)
                final = [False] * (len(rows) - 1) + [bool(rows["is_last"].iloc[0])]
                return pd.DataFrame({"_conv": rows["_conv"], "pos": rows["pos"], "enters": [first, *states[:-1]], "leaves": states, "is_last": final})

            upper = solved.withColumnRenamed("pos", "_up")
            below = segments[k].withColumn("_up", F.expr(f"shiftright(pos, {BLOCK_BITS})")).join(upper, ["_conv", "_up"])
            top = top.unionByName(below.groupBy("_conv", "_up").applyInPandas(descend, path))
        solved = scratch.keep(top, f"solved-{k}")

    def act(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        convs, roles, at, out = rows["_conv"].tolist(), [role_of(r) for r in rows["role"]], rows["at"].tolist(), []
        enters, leaves, last = (rows[c].tolist() for c in ("enters", "leaves", "is_last"))
        for a, b in _runs(convs):
            states = [int(enters[a]), *trace([COSTS[r] for r in roles[a:b]], int(enters[a]), int(leaves[a]))]
            for i in range(a, b):
                cost, action, before = STEPS[roles[i]][states[i - a]][states[i - a + 1]]
                after = ENDING[states[-1]] if i == b - 1 and last[a] else ()
                out.append((at[i], action, ROLES[states[i - a + 1]], len(before), len(after), cost + INSERT * len(after), *frame(action, before, states[i - a + 1], after)))
        return pd.DataFrame(out, columns=["at", "action", "new_role", "empty_before", "empty_after", "cost", "lead", "tail"])

    roles = ordered.select(conv.alias("_conv"), "role", "at", "_block").join(solved.withColumnRenamed("pos", "_block"), ["_conv", "_block"])
    acts = roles.groupBy("_block").applyInPandas(act, "at long, action string, new_role string, empty_before int, empty_after int, cost int, lead string, tail string")
    rendered = F.concat("lead", escaped(F.col("text")), "tail")
    return ordered.join(acts, "at").select("conv_id", "turn", "role", "at", "action", "new_role", "empty_before", "empty_after", "cost", rendered.alias("rendered"))
