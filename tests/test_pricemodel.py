"""The price model over several numbers and categories, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression

from hostelry.plans import pricemodel as pm
from hostelry.registry import load
from hostelry.registry import model_queries as mq

SCHEMA = "id string, price double, a double, b double, c string, d string"
SMALL = pm.Table("id", "price", ["a", "b"], ["c", "d"])
REG = 0.05


def small_rows():
    rng = random.Random(5)
    out = []
    for i in range(240):
        a, b, c, d = rng.uniform(1, 9), rng.gauss(0, 3), rng.choice("xyz"), rng.choice(["p", "q", "p", "q", f"rare{i % 7}"])
        price = 20 + 5 * a + 2 * b + {"x": 0, "y": 30, "z": 60}[c] + rng.random() + (15 if d == "p" else 0)
        out.append((f"r{i}", None if i % 11 == 3 else price, None if i % 9 == 4 else a, b, None if i % 13 == 6 else c, d))
    return out


def ridge_by_hand(train, rows):
    """Medians, levels with ten rows or more, one-hot places, scaled columns, ridge of the log price: as matrices (the library scales by population deviations)."""
    known = [r for r in train if r[1] is not None]
    medians = [np.median([r[k] for r in known if r[k] is not None]) for k in (2, 3)]
    counts = [Counter(r[k] or "?" for r in known) for k in (4, 5)]
    shown = [{v: v if n >= 10 else "infrequent" for v, n in count.items()} for count in counts]

    def matrix(part):
        numbers = [[m if r[k] is None else r[k] for k, m in zip((2, 3), medians)] for r in part]
        codes = [[float(s.get(r[k] or "?") == v) for k, s in zip((4, 5), shown) for v in sorted(set(s.values()))] for r in part]
        return np.hstack([np.array(numbers), np.array(codes)])

    x, y = matrix(known), np.log1p([r[1] for r in known])
    mean, scale, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1), y.std()
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z / len(z) + REG / sd * np.eye(z.shape[1]), z.T @ (y - y.mean()) / len(z))
    return np.expm1(y.mean() + (matrix(rows) - mean) / scale @ beta)


def test_all_columns_reach_the_folds(spark):
    rows = small_rows()
    fold = {r[0]: int(hashlib.md5(f"42|{r[0]}".encode()).hexdigest()[:8], 16) % 5 for r in rows}
    want = {}
    for f in range(5):
        held = [r for r in rows if fold[r[0]] == f and r[1] is not None]
        guess = ridge_by_hand([r for r in rows if fold[r[0]] != f], held)
        want[f] = (np.mean(np.abs(guess - [r[1] for r in held])), len(held))
    got = pm.cross_validated(spark.createDataFrame(rows, SCHEMA), SMALL, LinearRegression(regParam=REG, solver="normal")).collect()
    assert {r["fold"]: (pytest.approx(r["mae"], rel=1e-6), r["rows"]) for r in got} == want


def test_a_search_of_two_learners_chooses_the_better_and_fills(spark):
    rows = small_rows()
    catalogue = {"strong": (LinearRegression(solver="normal"), {"regParam": [50.0]}), "ridge": (LinearRegression(solver="normal"), {"regParam": [REG]})}
    out = pm.estimate(spark.createDataFrame(rows, SCHEMA), SMALL, catalogue, k=2, seeds=(0,)).collect()
    missing = [r for r in rows if r[1] is None]
    guess = dict(zip([r[0] for r in missing], ridge_by_hand(rows, missing)))
    assert {r["id"]: r["final"] for r in out if r["estimated"]} == {k: pytest.approx(v, abs=0.006) for k, v in guess.items()}


def test_whole_jobs_are_registered_with_all_columns_and_learners(spark, monkeypatch):
    names = [n for n in load() if "_full_" in n]
    assert [n[:4] for n in sorted(names)] == [f"ml0{i}" for i in range(3, 10)]
    rows = small_rows()
    lines = [(r[0], r[1], r[2], 0.1, 0.0, 3, r[3], "A", r[4], r[5], "s") for r in rows]
    table = spark.createDataFrame(lines, "id string, price double, quantity double, discount double, tax double, size int, retail double, "
                                  "flag string, kind string, brand string, segment string")
    assert list(pm.learners()) == ["ridge", "forest", "boosted"]
    assert list(mq.ps.DEFAULTS) == ["ridge", "forest", "boosted"]
    monkeypatch.setattr(mq, "lines", lambda spark, folder: table)
    got = mq.full_cross_validation(spark, "").collect()
    assert Counter(r["learner"] for r in got) == {"ridge": 5, "forest": 5, "boosted": 5}
    short = pm.cross_validated(table, mq.ONE, mq.least_squares(), k=2).collect()
    for name in mq.ps.DEFAULTS:
        assert np.mean([r["mae"] for r in got if r["learner"] == name]) < 0.7 * np.mean([r["mae"] for r in short])


def test_line_of_all_splits_needs_no_fit_per_fold(spark, monkeypatch):
    rows = [(*r[:4], r[4] or "w", r[5]) for r in small_rows()]
    df, line = spark.createDataFrame(rows, SCHEMA), LinearRegression(regParam=REG, solver="normal")
    monkeypatch.setattr(pm, "fit", None)
    folds = {s: {r[0]: int(hashlib.md5(f"{s}|{r[0]}".encode()).hexdigest()[:8], 16) % 5 for r in rows} for s in (0, 1, 42)}

    def gaps(part, fold, f):
        held = [r for r in part if fold[r[0]] == f and r[1] is not None]
        return np.abs(ridge_by_hand([r for r in part if fold[r[0]] != f], held) - [r[1] for r in held])

    got = pm.repeated(df, SMALL, line, seeds=(0, 1)).first()
    errors = [gaps(rows, folds[s], f).mean() for s in (0, 1) for f in range(5)]
    assert got["folds"] == 10 and (got["mean"], got["worst"]) == (pytest.approx(np.mean(errors), rel=1e-6), pytest.approx(max(errors), rel=1e-6))
    many = {r["c"]: r["own_model"] for r in pm.one_or_many(df, SMALL, line, "c", ["x", "z"]).collect()}
    assert many == {v: pytest.approx(np.concatenate([gaps([r for r in rows if r[4] == v], folds[42], f) for f in range(5)]).mean(), rel=1e-6) for v in "xz"}


def test_blocks_of_an_importance_share_one_join(spark):
    df = spark.createDataFrame(small_rows(), SCHEMA)
    seen, held = pm.split(df, "id")
    fitted = pm.fit(seen, SMALL, LinearRegression(regParam=REG, solver="normal"))
    out = pm.importance(held, fitted, {"a": ["a"], "ac": ["a", "c"], "b": ["b"]}, repeats=2)
    known = sorted([r for r in small_rows() if r[1] is not None and int(hashlib.md5(f"42|{r[0]}".encode()).hexdigest()[:8], 16) % 5 == 0])
    train = [r for r in small_rows() if int(hashlib.md5(f"42|{r[0]}".encode()).hexdigest()[:8], 16) % 5]

    def error(rows):
        return np.mean(np.abs(ridge_by_hand(train, rows) - [r[1] for r in rows]))

    for r in out.collect():
        places = [2 + "abcd".index(x) for x in r["block"]]
        mae = []
        for i in range(2):
            other = sorted(known, key=lambda x: hashlib.md5(f"42|{i}|{x[0]}".encode()).hexdigest())
            mae.append(error([tuple(o[j] if j in places else x[j] for j in range(6)) for x, o in zip(known, other)]))
        assert (r["mae"], r["lost"]) == (pytest.approx(np.mean(mae), rel=1e-6), pytest.approx(np.mean(mae) - error(known), rel=1e-4, abs=1e-6))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("__pos" in x for x in plan.splitlines() if "Join Inner" in x) == 1
