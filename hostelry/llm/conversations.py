"""Repair of conversation structure as a lightest derivation.

A conversation is right if its role initials read ``(s?(ua)+)?``: nothing, or a system turn at most, then user and
assistant in turns. Edits: Keep a row (K, 0), Rerole it to user or assistant (R, 3), Delete it (D, 4; a must for blank
and repeated rows), Insert an empty user or assistant turn (I, 3). A truncated row that stays costs 3 more. The result
is the cheapest repair; among equals the one whose letters, in order, come first in ASCII.

An item ``(i, q)`` says: rows from ``i`` on can be repaired if what is before them has brought the grammar to state
``q``. An edit is a weighted deduction from the item behind it to the item before it. The agenda pops items by
``(cost, rows consumed, audit)``. Every deduction raises that triple (Keep costs nothing but consumes a row), so a
popped item is final, and the agenda stops when the goal items are. Letters are put in front, so of two audits of one
item the first letter decides: each state has one next role to insert or rerole to, so the deductions into an item have
different letters.

Rows are numbered by one global sort and cut into blocks of at most ``BLOCK`` rows, and only a string with one sign
per row goes to Python, so a conversation of any length is many small tasks. A block gives the weight of every
derivation from state to state. Blocks of a conversation join in groups of ``FAN``, level by level, by the same
deduction (item over two adjoining spans); then the states go down again and each block writes its edits. Within
a block inserts come before a row, so no audit of a block is the beginning of another one of it, and the order of two
whole audits is the order at the first block where they differ.

Cases: null role or text counts as one space, so such a text is blank; roles are judged by their first character,
other initials than s, u, a (an empty role too) must be reroled or deleted; rows are ordered by turn (null first), role
and text, so ties and repeated rows have a place; a null conversation id is a conversation; a conversation
without rows does not exist; an empty table gives empty tables; other columns are ignored whatever their names; texts
of any length are read whole and never leave the JVM.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostelry.llm.ordering import numbered
from hostelry.operators.distribution import attach, spread_join
from hostelry.session import discard, durable

#: Rows of a block, and blocks (or groups of blocks) that join in one step.
BLOCK, FAN = 2048, 1024
BLANKS = " \t\n\v\f\r"
#: States: nothing yet, after system, after user, after assistant. Role a state can insert or rerole to, and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Inserts that end a conversation in a state.
REST = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
NONE = 2**62

EDIT = T.StructType([
    T.StructField("row", T.IntegerType()), T.StructField("step", T.IntegerType()),
    T.StructField("edit", T.StringType()), T.StructField("role", T.StringType())])


def _deductions(sign: str) -> list[tuple[int, int, int, str]]:
    """What a row of this sign allows: state before, state behind, cost, letter. ``x``: has to go; upper case: truncated."""
    out = [(q, q, DELETE, "D") for q in range(4)]
    if sign != "x":
        more = TRUNCATED if sign.isupper() else 0
        out += [(q, r, more, "K") for (q, initial), r in KEEP.items() if initial == sign.lower()]
        out += [(q, NEXT[q][1], REROLE + more, "R") for q in range(4)]
    return out


def derive(shape: str, goal: int) -> dict[int, tuple[int, str]]:
    """Lightest derivation of the whole block from each state to ``goal``: cost and letters. Popped as an agenda."""
    n = len(shape)
    into: dict[str, list[list[tuple[int, int, str]]]] = {}
    for sign in set(shape):
        at = into[sign] = [[] for _ in range(4)]
        for before, behind, cost, letter in _deductions(sign):
            at[behind].append((before, cost, letter))
    inserts: list[list[int]] = [[] for _ in range(4)]
    for q in range(4):
        inserts[NEXT[q][1]].append(q)
    final: dict[tuple[int, int], tuple[int, str, tuple[int, int] | None]] = {}
    agenda = [(0, 0, "", n, goal, None)]
    while agenda:
        cost, consumed, letter, i, q, premise = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q] = cost, letter, premise
        if i == 0 and all((0, p) in final for p in range(4)):
            break
        if i < n:  # inserts come before a row; those at the end are the next block's
            for before in inserts[q]:
                if (i, before) not in final:
                    heapq.heappush(agenda, (cost + INSERT, consumed, "I", i, before, (i, q)))
        if i > 0:
            for before, more, letter in into[shape[i - 1]][q]:
                if (i - 1, before) not in final:
                    heapq.heappush(agenda, (cost + more, consumed + 1, letter, i - 1, before, (i, q)))
    out = {}
    for q in range(4):
        if (0, q) in final:
            letters, at = [], (0, q)
            while at is not None:
                _, letter, premise = final[at]
                letters.append(letter)
                at = premise
            out[q] = final[0, q][0], "".join(letters)
    return out


@lru_cache(maxsize=4096)
def _cells(shape: str) -> tuple[int, ...]:
    """Costs from state to state (16, row by row), then the place of each among the audits of its first state."""
    by_goal = [derive(shape, g) for g in range(4)]
    costs, places = [], []
    for q in range(4):
        found = sorted((d[q][1], g) for g, d in enumerate(by_goal) if q in d)
        place = {g: k for k, (_, g) in enumerate(found)}
        costs += [by_goal[g][q][0] if q in by_goal[g] else NONE for g in range(4)]
        places += [place.get(g, 4) for g in range(4)]
    return (*costs, *places)


def _chain(children: list[list[int]], goal: int) -> list[list[int]]:
    """Per child the next state for each state (-1: none) on the lightest way to ``goal`` behind the last child."""
    best = [NONE] * 4
    best[goal] = 0
    steps = []
    for cells in reversed(children):
        here, step = [], []
        for q in range(4):
            cost, _, behind = min(
                ((cells[4 * q + r] + best[r], cells[16 + 4 * q + r], r) for r in range(4) if cells[4 * q + r] < NONE and best[r] < NONE),
                default=(NONE, 4, -1))
            here.append(cost)
            step.append(behind)
        best = here
        steps.append(step)
    return [best, *reversed(steps)]


def _way(steps: list[list[int]], q: int) -> list[int]:
    way = [q]
    for step in steps:
        way.append(step[way[-1]])
    return way


def _join(children: list[list[int]]) -> list[int]:
    """Cells of adjoining spans as one."""
    chains = [_chain(children, g) for g in range(4)]
    costs, places = [], []
    for q in range(4):
        known = [g for g in range(4) if chains[g][0][q] < NONE]
        ways = {g: _way(chains[g][1:], q) for g in known}
        # the first child where two ways part says which audit is less
        ordered = sorted(known, key=lambda g: [c[16 + 4 * a + b] for c, a, b in zip(children, ways[g], ways[g][1:])])
        costs += [chains[g][0][q] for g in range(4)]
        places += [ordered.index(g) if g in known else 4 for g in range(4)]
    return costs + places


def _ends(cells: list[int]) -> tuple[int, int]:
    """Total cost and last state of the best repair of a whole conversation that begins with nothing."""
    cost, _, state = min((cells[g] + INSERT * REST[g], cells[16 + g], g) for g in range(4) if cells[g] < NONE)
    return cost, state


@lru_cache(maxsize=4096)
def _edits(shape: str, start: int, goal: int, last: bool) -> tuple[tuple[int, int, str, str | None], ...]:
    """Edits of a block: its row (one past the end for closing inserts), their order there, letter, role if it is new."""
    letters = derive(shape, goal)[start][1] + ("I" * REST[goal] if last else "")
    out, row, step, q = [], 0, 0, start
    for letter in letters:
        role = None
        if letter in "IR":
            role, behind = NEXT[q]
        elif letter == "K":
            behind = KEEP[q, shape[row].lower()]
        else:
            behind = q
        out.append((row, step, letter, role))
        q, step = behind, step + 1
        if letter != "I":
            row, step = row + 1, 0
    return tuple(out)


def _mapped(df: DataFrame, field: T.StructField, function, *inputs: str) -> DataFrame:
    """Adds ``field``, computed from the named columns row by row, in Arrow batches."""
    schema = T.StructType([*df.schema.fields, field])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            made = [function(*row) for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs), strict=True)]
            value = pa.array(made, type=arrow.field(len(arrow) - 1).type)
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(batch.columns, arrow)], value], schema=arrow)

    return df.mapInArrow(run, schema)


_CELLS = T.StructField("cells", T.ArrayType(T.LongType()))
_WAY = T.StructField("way", T.ArrayType(T.IntegerType()))


def _solve(blocks: DataFrame) -> DataFrame:
    """Adds to blocks (``conv_``, ``block``, ``shape``, ``cells``) the states they begin and end in, ``last`` and
    the conversation's ``cost``. Goes up and down as many levels as the longest conversation needs."""
    levels = [blocks.select("conv_", F.col("block").alias("part"), "cells")]
    written = []
    while levels[-1].groupBy("conv_").count().where("count > 1").limit(1).count():
        joined = levels[-1].groupBy("conv_", F.floor(F.col("part") / FAN).alias("part")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("part", "cells"))), lambda c: c["cells"]).alias("children"))
        levels.append(durable(_mapped(joined, _CELLS, _join, "children").select("conv_", "part", "cells")))
        written.append(levels[-1])
    ends = T.StructField("ends", T.ArrayType(T.LongType()))
    top = _mapped(levels.pop(), ends, _ends, "cells")
    states = top.select(
        "conv_", "part", F.lit(START).alias("start"), F.col("ends")[1].cast("int").alias("goal"), F.lit(True).alias("last"), F.col("ends")[0].alias("cost"))
    while levels:
        below = levels.pop().withColumn("up", F.floor(F.col("part") / FAN))
        groups = below.groupBy("conv_", "up").agg(F.sort_array(F.collect_list(F.struct("part", "cells"))).alias("children"))
        above = states.withColumnRenamed("part", "up")
        both = spread_join(groups, above, ["conv_", "up"]).withColumn("inner", F.col("children.cells"))
        went = _mapped(both, _WAY, lambda inner, start, goal: _way(_chain(inner, goal)[1:], start), "inner", "start", "goal")
        states = went.select("conv_", "last", "cost", "way", F.size("children").alias("n"), F.posexplode("children").alias("i", "child")).select(
            "conv_", F.col("child.part").alias("part"), F.col("way")[F.col("i")].alias("start"), F.col("way")[F.col("i") + 1].alias("goal"),
            (F.col("last") & (F.col("i") == F.col("n") - 1)).alias("last"), "cost")
    done = durable(spread_join(blocks.drop("cells"), states.withColumnRenamed("part", "block"), ["conv_", "block"]))
    discard(*written)
    return done


def own_fault(text: Column) -> Column:
    """Blank, truncated, or null."""
    inner = F.rtrim(text, F.lit(BLANKS))
    return F.when(inner == "", "blank").when(~F.substring(inner, -1, 1).isin(".", "!", "?"), "truncated")


def repair(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``rows, edits``.

    ``rows``: the rows as they were: ``conv_``, ``at`` (place in the whole table, growing through a conversation),
    ``turn``, ``initial`` of the role, ``fault`` (the first that fits). ``edits``: one row per edit: ``conv_``, ``at`` (row it is made
    at; inserts come before it), ``step`` (order there), ``edit`` (K, R, D, I), ``role`` and ``text`` of what stays
    or comes in (null: deleted), ``cost`` of the whole conversation.
    """
    def known(name):
        return F.coalesce(F.col(name), F.lit(" "))

    plain = conversations.select(F.col(conv_col).alias("conv_"), F.col(turn_col).alias("turn"), known(role_col).alias("role"), known(text_col).alias("text"))
    order = [F.col("conv_").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = numbered(plain, order, "at")
    slim = durable(placed.select(
        "conv_", "at", "turn", F.substring("role", 1, 1).alias("initial"), F.sha2(F.concat("role", F.lit("\n"), "text"), 256).alias("said"),
        own_fault(F.col("text")).alias("own")))
    first = slim.groupBy("conv_", "said").agg(F.min("at").alias("first"))
    rows = durable(attach(slim, first, ["conv_", "said"]).select(
        "conv_", "at", "turn", "initial",
        F.when(F.col("own") == "blank", "blank").when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("own")).alias("fault")))
    discard(slim)

    own = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    sign = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(own)).otherwise(own)
    shapes = rows.groupBy("conv_", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        F.min("at").alias("from"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", sign.alias("sign")))), lambda r: r["sign"]), "").alias("shape"))
    blocks = durable(_mapped(shapes, _CELLS, _cells, "shape"))
    solved = _solve(blocks)
    discard(blocks)
    made = _mapped(solved, T.StructField("edits", T.ArrayType(EDIT)), _edits, "shape", "start", "goal", "last").select(
        "conv_", "from", "cost", F.explode("edits").alias("e")).select(
        F.col("conv_").alias("of"), (F.col("from") + F.col("e.row")).alias("place"), F.col("e.step").alias("step"), F.col("e.edit").alias("edit"),
        F.col("e.role").alias("new"), "cost")
    there = (F.col("place") == F.col("at")) & (F.col("edit") != "I")
    edits = made.join(placed.select("at", "role", "text"), there, "left").select(
        F.col("of").alias("conv_"), F.col("place").alias("at"), "step", "edit",
        F.when(F.col("edit") != "D", F.coalesce("new", "role")).alias("role"),
        F.when(F.col("edit") == "I", "").when(F.col("edit") != "D", F.col("text")).alias("text"), "cost")
    return rows, edits


def report(rows: DataFrame, edits: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per id in ``conversations``: faults, what was wrong, the cost and letters of the repair, and its digest.

    The digest and the letters of a conversation are one value over all of it, so here a conversation is one row."""
    def count(kind):
        return F.count(F.when(F.col("fault") == kind, 1)).alias(kind)

    seen = rows.groupBy("conv_").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *map(count, ("blank", "duplicate", "truncated")))
    behind = rows.select(F.col("conv_").alias("conv_b"), (F.col("at") - 1).alias("at_b"), F.col("initial").alias("next"))
    pairs = rows.join(behind, (F.col("at") == F.col("at_b")) & F.col("conv_").eqNullSafe(F.col("conv_b")))
    illegal = pairs.groupBy("conv_").agg(F.count(F.when(~F.concat("initial", "next").isin("su", "ua", "au"), 1)).alias("illegal"))
    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
    mended = edits.groupBy("conv_").agg(
        F.first("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("at", "step", "edit", line.alias("line")))).alias("all")
    ).select(
        "conv_", "cost", F.array_join("all.edit", "").alias("audit"),
        F.sha2(F.array_join("all.line", "\n"), 256).alias("repaired_sha256"))
    ids = conversations.select(F.col(conv_col).alias("conv_")).distinct()
    whole = ids
    for part in (seen, illegal, mended):
        whole = attach(whole, part, ["conv_"])
    return whole.select(
        F.col("conv_").alias(conv_col), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
