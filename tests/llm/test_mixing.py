"""Weighted fair queueing against a plain loop."""

import hashlib
import random
import re

import duckdb
import pytest

from hostelry.llm import mixing, queries
from tools.check import rows_of

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, text string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fair_targets(sizes, weights, passes):
    """Shares by weight; what lies above a stop is shared again among the others."""
    target = dict.fromkeys(sizes, 0.0)
    open_, left = set(sizes), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / total
        over = {s for s in open_ if target[s] > passes * sizes[s]}
        left = sum(target[s] - passes * sizes[s] for s in over)
        for s in over:
            target[s] = float(passes * sizes[s])
        open_ -= over
    return target


def served(rows, weights=(1, 2, 3), passes=3):
    """Words taken per row, queue by queue, one document at a time."""
    names = sorted({r[1] for r in rows if r[1] is not None}) + ([None] if any(r[1] is None for r in rows) else [])
    sizes = {s: sum(words(r[2]) for r in rows if r[1] == s) for s in names}
    target = fair_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, passes)
    out = []
    for s in names:
        queue = sorted((r for r in rows if r[1] == s), key=lambda r: (
            hashlib.md5("|".join(["0", "" if r[0] is None else str(r[0]), r[2] or ""]).encode()).hexdigest(), r[0] is not None, r[0] or 0))
        got, left = [0] * len(queue), int(target[s] + 1e-9)
        for _ in range(passes):
            for i, r in enumerate(queue):
                take = min(words(r[2]), left)
                got[i] += take
                left -= take
        out += [(r[0], words(r[2]), sizes[s], round(target[s], 6), g) for r, g in zip(queue, got)]
    return sorted(out, key=repr), target


def sample():
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"s{i % 13}", " ".join(["w"] * rng.choice([0, 1, 5, 40]))) for i in range(300)]
    rows += [(900, "tiny", "a"), (901, "blank", " \t\n"), (902, "none", None), (None, None, "x y z"), (None, "s1", "x  y"), (903, "long", "ab " * 30000)]
    return rows + [(7, "hot", "same words here")] * 40 + [(8, "é", "w"), (9, "z", "w " * 11)]


def test_matches_a_loop_over_queues(spark):
    rows = sample()
    want, target = served(rows)
    got = mixing.taken(mixing.mix(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=repr) == want
    for s in target:
        assert 0 <= target[s] - sum(r.taken for r in got if r.source == s) < 1 + 1e-6
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_the_queue_is_one_order_without_gaps(spark):
    mixed = [r for r in mixing.mix(spark.createDataFrame(sample(), SCHEMA)).collect() if r.words]
    mixed.sort(key=lambda r: r.offset)
    assert [r.finish for r in mixed] == sorted(r.finish for r in mixed)
    assert [r.offset for r in mixed] == [sum(x.words for x in mixed[:i]) for i in range(len(mixed))]
    budget = sum(words(r[2]) for r in sample())
    assert budget - len({r.source for r in mixed}) <= mixed[-1].offset + mixed[-1].words <= budget
    cut = [r for r in mixed if r.words < r["size"]]
    assert all(r.finish > 1 for r in cut) and len({r.source for r in cut}) == len(cut)


def test_another_plan_gives_the_same_mix(spark, settings, monkeypatch):
    df = spark.createDataFrame(sample(), SCHEMA)
    one = sorted(map(repr, mixing.taken(mixing.mix(df)).collect()))
    settings(**{"spark__sql__shuffle__partitions": "13", "spark__sql__adaptive__enabled": "false"})
    monkeypatch.setattr(mixing, "STEP", 7)
    assert sorted(map(repr, mixing.taken(mixing.mix(df.repartition(5))).collect())) == one


def test_other_columns_seeds_and_passes(spark):
    rows = [(i, "ab"[i % 2], "w " * (i + 1)) for i in range(20)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", size string, target int")
    twice = mixing.taken(mixing.mix(df, (1, 9), passes=1)).collect()
    assert all(r.taken <= r["size"] for r in twice) and sum(r.taken for r in twice) <= 210
    order = [[r.doc_id for r in mixing.mix(df, seed=s).where("words > 0").orderBy("offset").collect()] for s in ("0", "1")]
    assert order[0] != order[1]


@pytest.mark.parametrize("rows", [[], [(1, "a", None), (2, None, "")]])
def test_nothing_to_serve(spark, rows):
    got = mixing.taken(mixing.mix(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == [(r[0], 0, 0, 0.0, 0) for r in rows]


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    df = queries.op11_mixing(spark, FOLDER)
    cursor = db.execute(queries.OP11)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("unit", [1, 400_000_000, 900_000_000_000])
def test_targets_of_more_words_than_an_int_holds(spark, unit):
    rows = [("a", 1, 2 * unit), ("b", 2, unit), ("c", 3, 6 * unit), ("d", 2, unit // 1000)]
    sources = spark.createDataFrame(rows, "source string, weight int, size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sources, "weight", "size", 2).collect()}
    budget = sum(r[2] for r in rows)
    open_ = budget - 2 * unit - 2 * (unit // 1000)  # b and d stop at twice their size
    assert found == {"a": pytest.approx(open_ / 4), "b": 2 * unit, "c": pytest.approx(open_ * 3 / 4), "d": 2 * (unit // 1000)}
