"""Lightest repairs against trying every edit."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from hostelry.llm import conversations as conv
from hostelry.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\v\f\r"


def judged(rows):
    """Rows in order with their first fault."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, out = set(), []
    for turn, role, text in rows:
        inner = text.rstrip(BLANKS)
        fault = "blank" if not inner else "duplicate" if (role, text) in seen else None if inner[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """Every edit at every row, with up to two inserts before it and at the end: least (cost, letters), and the lines."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def rest(i, q, inserted):
        options = []
        if inserted < 2:
            for r in "ua":
                if (q, r) in legal:
                    cost, letters, lines = rest(i, r, inserted + 1)
                    options.append((cost + 3, "I" + letters, (full[r] + ":", *lines)))
        if i == len(rows):
            if q in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text, fault = rows[i]
            cost, letters, lines = rest(i + 1, q, 0)
            options.append((cost + 4, "D" + letters, lines))
            if fault in (None, "truncated"):
                more = 3 * (fault == "truncated")
                for r, name, edit in [(role[:1], role, "K"), ("u", "user", "R"), ("a", "assistant", "R")]:
                    if (q, r) in legal:
                        cost, letters, lines = rest(i + 1, r, 0)
                        options.append((cost + more + 3 * (edit == "R"), edit + letters, (f"{name}:{text}", *lines)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    return rest(0, "", 0)


def expected(rows, ids):
    out = []
    for c in ids:
        mine = judged([r for r in rows if r[0] == c])
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(mine, mine[1:])]
        cost, audit, lines = cheapest(tuple(mine))
        out.append((c, gaps, *(sum(f == k for *_, f in mine) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, ids=None):
    df = spark.createDataFrame(rows, SCHEMA)
    whole = df if ids is None else spark.createDataFrame([(i,) for i in ids], "conv_id long")
    return sorted((tuple(r) for r in conv.report(*conv.repair(df), whole).collect()), key=repr)


def sample(n=60, seed=1):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "No!", "So?\n", "cut off", " \t", "", None, "Hm. \x85", "é", "日本.", "a.", "b.", "c.", "d.", "e."]
    return [(c, rng.choice([None, 0, 1, 2, 5, 9]), rng.choice(roles), rng.choice(texts)) for c in range(n) for _ in range(rng.randrange(9))] + [
        (None, 1, "user", "Null id."), (None, 2, "assistant", "Yes.")]


@pytest.mark.parametrize("block,fan", [(2048, 1024), (3, 2), (1, 2)])
def test_matches_every_edit(spark, monkeypatch, block, fan):
    monkeypatch.setattr(conv, "BLOCK", block)
    monkeypatch.setattr(conv, "FAN", fan)
    rows = sample()
    ids = sorted({r[0] for r in rows if r[0] is not None}) + [None, 999]
    assert got(spark, rows, ids) == expected(rows, ids)


def test_agenda_alone():
    rng = random.Random(9)
    for _ in range(300):
        shape = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(1, 9)))
        name = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "x"}
        rows = tuple((i, name[c.lower()], "t", "blank" if c == "x" else "truncated" if c.isupper() else None) for i, c in enumerate(shape))
        cost, audit, _ = cheapest(rows)
        cells = list(conv._cells(shape))
        total, state = conv._ends(cells)
        assert (total, "".join(e[2] for e in conv._edits(shape, 0, state, True))) == (cost, audit)
        halves = [list(conv._cells(shape[:k])) for k in (1,)] + [list(conv._cells(x)) for x in shape[1:]]
        assert conv._join(halves) == cells


def test_a_long_conversation_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(conv, "BLOCK", 50)
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}" + ("." if i % 7 else "")) for i in range(701)] + [(2, 0, "user", "x" * 300000 + ".")]
    out = {r[0]: r for r in got(spark, rows)}
    assert out[1][6:8] == (3 * 100 + 4, "K" * 700 + "D") and out[2][6:8] == (3, "KI")


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == [] and got(spark, [], [4]) == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    rows = sample(8)
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", at int, edit string, conv_ string")
    out = conv.report(*conv.repair(df), df).collect()
    assert sorted(map(tuple, out), key=repr) == expected(rows, list({r[0] for r in rows}))


def test_query_over_the_damaged_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = []
    whole = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    for c, t, role, text in whole:
        harm = zlib.crc32(f"{c}:{t}".encode()) % 20
        text = "" if harm == 1 else "".join(x for x in text if x not in ".!?") if harm == 2 else text
        rows += [(c, t, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = queries.op13_conversations(spark, folder).collect()
    assert sorted(map(tuple, out), key=repr) == expected(rows, list({r[0] for r in whole}))
