"""Distance operators against plain loops on small fixtures."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hostelry.operators import demand, polygons, spatial
from hostelry.registry.spatial_queries import radius_join


def scattered(seed, n, crowd=0.33):
    """Points with a third of them in one small crowd, some at the very same spot."""
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 5000, (n, 2))
    m = int(n * crowd)
    xy[:m] = 2500 + rng.normal(0, 3, (m, 2))
    xy[: m // 3] = xy[0]
    return pd.DataFrame({"id": np.arange(n), "x": xy[:, 0], "y": xy[:, 1], "k": rng.integers(0, 3, n)})


def sites_of(spark, frame):
    return spark.createDataFrame(frame).select(F.col("id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"), "k")


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_nearest_matches_all_distances(spark, settings, broadcast):
    settings(spark__sql__autoBroadcastJoinThreshold=broadcast, spark__sql__adaptive__autoBroadcastJoinThreshold=broadcast)
    a, b = scattered(1, 300), scattered(2, 260)
    got = spatial.nearest(spark.createDataFrame(a).withColumnRenamed("id", "pid"), sites_of(spark, b), ["k"]).toPandas().set_index("pid")
    for r in a.itertuples():
        same = b[b.k == r.k]
        d = np.hypot(same.x - r.x, same.y - r.y)
        assert np.isclose(got.d[r.id], d.min())
        assert got.sid[r.id] == same.id[d <= d.min() + 1e-9].min()


def test_nearest_open_site_by_gate(spark):
    a, b = scattered(3, 120), scattered(4, 90)
    a["gate"] = [f"{i * 37 % 101:03d}" for i in a.id]
    b["gate"] = [None if i % 4 == 0 else f"{i * 17 % 101:03d}" for i in b.id]
    b = b[(b.k != 2) | b.gate.notna()]
    sites = spark.createDataFrame(b).select(F.col("id").alias("sid"), F.col("x").alias("sx"), F.col("y").alias("sy"), "k", "gate")
    got = spatial.nearest(spark.createDataFrame(a).withColumnRenamed("id", "pid"), sites, ["k"], gate="gate").toPandas().set_index("pid")
    for r in a.itertuples():
        free = b[(b.k == r.k) & (b.gate.isna() | (b.gate > r.gate))]
        if free.empty:
            assert r.id not in got.index
        else:
            assert np.isclose(got.d[r.id], np.hypot(free.x - r.x, free.y - r.y).min())


def test_nearest_without_sites_is_empty(spark):
    a = spark.createDataFrame(scattered(1, 5)).withColumnRenamed("id", "pid")
    assert spatial.nearest(a, sites_of(spark, scattered(2, 5)).filter("sid < 0")).count() == 0


def test_pairs_within_matches_all_distances(spark):
    a, b = scattered(5, 200), scattered(6, 150)
    pairs = spatial.pairs_within(spark.createDataFrame(a).select("id", "x", "y"), sites_of(spark, b).drop("k"), 200.0)
    got = {(r["id"], r["sid"]) for r in pairs.collect()}
    d = np.hypot(a.x.to_numpy()[:, None] - b.x.to_numpy(), a.y.to_numpy()[:, None] - b.y.to_numpy())
    assert got == set(zip(*np.nonzero(d <= 200.0)))


def test_spread_matches_matrix_and_loses_nothing(spark):
    a, b = scattered(7, 200), scattered(8, 100)
    a["w"] = (a.id % 7 + 1).astype(float)
    out = demand.spread(spark.createDataFrame(a), sites_of(spark, b).drop("k"), 150.0).toPandas().set_index("sid")
    d = np.hypot(a.x.to_numpy()[:, None] - b.x.to_numpy(), a.y.to_numpy()[:, None] - b.y.to_numpy())
    inside = (d <= 150.0).astype(float)
    alone = inside.sum(axis=1) == 0
    inside[alone, d[alone].argmin(axis=1)] = 1.0
    want = a.w.to_numpy() @ (inside / inside.sum(axis=1, keepdims=True))
    assert np.allclose(out.received[b.id].to_numpy(), want)
    assert np.isclose(out.received.sum(), a.w.sum())


def test_near_same_key_matches_all_pairs(spark):
    a = scattered(9, 250)
    a["key"] = a.k.map({0: "p", 1: "q", 2: None})
    rows = spark.createDataFrame(a[["id", "x", "y", "key"]])
    got = spatial.near_same_key(rows, ["key"], "id", 200.0, "near").toPandas().set_index("id").near
    for r in a.itertuples():
        rest = a[(a.key == r.key) & (a.id != r.id)]
        assert got[r.id] == bool((np.hypot(rest.x - r.x, rest.y - r.y) < 200.0).any())


def test_keep_newest_apart_matches_greedy(spark):
    a = scattered(10, 300)
    a["name"] = a.k.map({0: "bar", 1: "cafe", 2: None})
    a["seen"] = (a.id * 7919) % 50
    rows = spark.createDataFrame(a[["id", "x", "y", "name", "seen"]])
    got = {r["id"] for r in spatial.keep_newest_apart(rows, "name", "id", [F.col("seen")], 100.0).collect()}
    want = set(a[a.name.isna()].id)
    for _, g in a.dropna(subset=["name"]).groupby("name"):
        kept = []
        for r in g.sort_values(["seen", "id"], ascending=False).itertuples():
            if all(np.hypot(r.x - q.x, r.y - q.y) > 100.0 for q in kept):
                kept.append(r)
        want |= {r.id for r in kept}
    assert got == want


def greedy(frame, radius):
    """Ids that survive a plain walk from the newest to the oldest row of each name."""
    want = set()
    for _, g in frame.groupby("name"):
        kept = []
        for r in g.sort_values(["seen", "id"], ascending=False).itertuples():
            if all(np.hypot(r.x - q.x, r.y - q.y) > radius for q in kept):
                kept.append(r)
        want |= {r.id for r in kept}
    return want


def corners(spark, frame, radius):
    return {r["id"] for r in spatial.keep_newest_apart(spark.createDataFrame(frame), "name", "id", [F.col("seen")], radius).collect()}


def test_chains_over_tiles_and_crowded_cells(spark, monkeypatch):
    rng = np.random.default_rng(3)
    line = pd.DataFrame({"x": np.arange(300) * 7.0 - 900, "y": 0.0, "name": "line", "seen": np.arange(300)})
    crowd = pd.DataFrame({"x": rng.normal(0, 9, 700), "y": rng.normal(0, 9, 700), "name": "crowd", "seen": rng.integers(0, 9, 700)})
    field = pd.DataFrame({"x": rng.uniform(-400, 400, 700), "y": rng.uniform(-400, 400, 700), "name": "field", "seen": rng.integers(0, 400, 700)})
    frame = pd.concat([line, crowd, field], ignore_index=True)
    frame["id"] = rng.permutation(len(frame))
    rounds = []
    plain = spatial._winners
    monkeypatch.setattr(spatial, "_winners", lambda *a: rounds.append(a[1]) or plain(*a))
    assert corners(spark, frame, 10.0) == greedy(frame, 10.0)
    # the longest chain has 300 rows and crosses 10 tiles, each in one round
    assert len(rounds) <= 14


def test_small_views_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"x": rng.normal(0, 30, 250), "y": rng.normal(0, 30, 250), "name": "n", "seen": rng.integers(0, 40, 250), "id": np.arange(250)})
    for option, value in (("TILE_BITS", 3), ("LISTED", 2), ("CALL_ROWS", 10)):
        monkeypatch.setattr(spatial, option, value)
    assert corners(spark, frame, 10.0) == greedy(frame, 10.0)


def test_corner_distances(spark):
    plane = pd.DataFrame({"id": [1, 2, 3, 4], "x": [0.0, 6.0, 100.0, 111.0], "y": [0.0] * 4, "name": list("aabb"), "seen": [1, 2, 1, 2]})
    out = spatial.keep_newest_apart(spark.createDataFrame(plane), "name", "id", [F.col("seen")], 10.0)
    assert {r["id"] for r in out.collect()} == {2, 3, 4}


def square(x0, y0, side):
    return [[x0, y0], [x0 + side, y0], [x0 + side, y0 + side], [x0, y0 + side], [x0, y0]]


def test_polygons_with_hole_island_and_border(spark):
    shapes = [(1, [[square(0.0, 0.0, 10.0)], [square(2.0, 2.0, 6.0)], [square(4.0, 4.0, 2.0)]]), (2, [[square(5.0, -20.0, 3.0)]])]
    rows = spark.createDataFrame(shapes, "id int, c array<array<array<array<double>>>>")
    sides = polygons.edges(polygons.rings(rows, "id", "c"), "id")
    points = [(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 5.0, 5.0), (4, 10.0, 5.0), (5, 6.0, -19.0), (6, 50.0, 50.0), (7, None, 1.0)]
    found = polygons.locate(spark.createDataFrame(points, "p int, lon double, lat double"), sides.withColumnRenamed("id", "poly"), "poly")
    assert {r["p"]: r["polygon"] for r in found.collect()} == {1: 1, 2: None, 3: 1, 4: None, 5: 2, 6: None, 7: None}
    nested = polygons.nest(sides, "id")
    roles = {(r["id"], r["ring"]): (r["role"], r["parent"]) for r in nested.collect()}
    assert roles == {(1, 0): ("part", None), (1, 1 << 32): ("hole", 0), (1, 2 << 32): ("part", None), (2, 0): ("part", None)}
    areas = {r["id"]: r["area"] for r in polygons.feature_areas(nested, "id").collect()}
    assert areas == {1: 68.0, 2: 9.0}
    stated = spark.createDataFrame([(1, 68.5), (2, 10.0)], "id int, stated double")
    assert [r["id"] for r in polygons.area_offenders(polygons.feature_areas(nested, "id"), stated, "id", "stated").collect()] == [2]


def held(x, y, sides):
    """Even–odd by every edge, outside on the border."""
    odd = False
    for x1, y1, x2, y2 in sides:
        if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return False
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def star(rng, x, y, size, n):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [[x + size * rng.uniform(0.3, 1) * math.cos(t), y + size * rng.uniform(0.3, 1) * math.sin(t)] for t in turns]
    return [*ring, ring[0]]


def comb(x, y, teeth):
    ring = [[x, y]]
    for i in range(teeth):
        ring += [[x + i, y + 50.0], [x + i + 0.5, y + 50.0], [x + i + 0.5, y + 1.0], [x + i + 1.0, y + 1.0]]
    return [*ring, [x + teeth, y], [x, y]]


def test_polygons_of_all_scales_against_every_edge(spark):
    rng = random.Random(6)
    shapes = [(i, [[star(rng, rng.uniform(-60, 60), rng.uniform(-60, 60), rng.choice([0.01, 1, 8, 40]), rng.choice([3, 9, 60]))]]) for i in range(40)]
    shapes += [(90, [[square(0.0, 0.0, 1.0)], [square(0.25, 0.25, 0.5)]]), (91, [[comb(-20.0, -20.0, 30)]]), (92, [[square(-64.0, -64.0, 128.0)]])]
    rows = spark.createDataFrame(shapes, "id int, c array<array<array<array<double>>>>")
    sides = polygons.edges(polygons.rings(rows, "id", "c"), "id").withColumnRenamed("id", "poly")
    plain = {i: [(*a, *b) for part in c for ring in part for a, b in zip(ring, ring[1:])] for i, c in shapes}
    spots = [(rng.uniform(-70, 70), rng.uniform(-70, 70)) for _ in range(300)]
    for edges_ in plain.values():  # vertices, places on borders and close to them, and level with vertices
        for x1, y1, x2, y2 in rng.sample(edges_, min(6, len(edges_))):
            spots += [(x1, y1), ((x1 + x2) / 2, (y1 + y2) / 2), (x1 + 1e-7, y1), (x1 - 0.2, y1), (x1, y1 + 0.3)]
    spots += [(0.5, 0.5), (0.25, 0.3), (0.1, 0.25), (-19.75, 0.0), (-19.4, 0.0), (float("nan"), 0.0)]
    points = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)] + [(9999, None, 0.0)], "p int, lon double, lat double")
    got = {r["p"]: r["inside"] for r in polygons.containing(points, sides, "poly").collect()}
    assert got == {i: sorted(k for k, e in plain.items() if held(*s, e)) for i, s in enumerate(spots)} | {9999: []}


def test_cells_follow_edges_not_the_mix_of_sizes(spark):
    small = [(i, [[square(1000.0 + 0.01 * i, 0.0, 0.005)]]) for i in range(400)]
    big = [[(500 + 50 * math.sin(9 * t)) * f(t) for f in (math.cos, math.sin)] for t in np.linspace(0, 2 * math.pi, 4000, endpoint=False).tolist()]
    big.append(big[0])
    rows = spark.createDataFrame([*small, (999, [[big]])], "id int, c array<array<array<array<double>>>>")
    sides = polygons.edges(polygons.rings(rows, "id", "c"), "id")
    edges_ = sides.count()
    seen = polygons.cover(sides, "id").select(F.explode("polygons").alias("p")).select("p.id", F.size("p.edges").alias("n"))
    many = seen.agg(F.count("*").alias("cells"), F.sum("n").alias("carried")).first()
    assert edges_ == 5600 and many["cells"] < 4 * edges_ and many["carried"] < 16 * edges_
    assert seen.where("id < 400").groupBy("id").count().agg(F.max("count")).first()[0] <= 36


def test_rings_meet_rings_of_their_own_feature_only(spark):
    shapes = [(i, [[square(0.0, 0.0, 10.0)], [square(1.0, 1.0, 2.0)]]) for i in range(60)] + [(None, [[square(0.0, 0.0, 9.0)], [square(2.0, 2.0, 3.0)]])]
    sides = polygons.edges(polygons.rings(spark.createDataFrame(shapes, "id int, c array<array<array<array<double>>>>"), "id", "c"), "id")
    per_cell = polygons.cover(sides.withColumnRenamed("ring", "around"), "around", ["id"]).agg(F.max(F.size("polygons"))).first()[0]
    assert per_cell <= 2
    roles = {(r["id"], r["ring"]): r["role"] for r in polygons.nest(sides, "id").collect()}
    assert all(roles[i, 0] == "part" and roles[i, 1 << 32] == "hole" for i in range(60))


def crowd(seed, n, width):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, width, (n, 2)) + 1000.0
    return pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "n": 1, "w": rng.integers(1, 9, n).astype(float)})


@pytest.mark.parametrize("width", [10.0, 300.0, 2000.0])
def test_totals_of_a_crowd_against_all_distances(spark, width):
    spots, at = crowd(1, 900, width), crowd(2, 40, width)
    sites = pd.DataFrame({"sid": range(40), "sx": at["x"], "sy": at["y"]})
    sites.loc[40] = [40, 9e6, 9e6]
    sites["sid"] = sites["sid"].astype(int)
    d = np.sqrt((spots["x"].to_numpy()[:, None] - sites["sx"].to_numpy()) ** 2 + (spots["y"].to_numpy()[:, None] - sites["sy"].to_numpy()) ** 2)
    got = spatial.totals_within(spark.createDataFrame(spots), spark.createDataFrame(sites), 200.0, ["n", "w"]).collect()
    want = {s: ((d[:, s] <= 200).sum(), spots["w"][d[:, s] <= 200].sum()) for s in range(41) if (d[:, s] <= 200).any()}
    assert {r["sid"]: (r["n"], r["w"]) for r in got} == want
    rings = spatial.ring_series(spark.createDataFrame(sites), spark.createDataFrame(spots), 25.0, 8, F.col("w")).collect()
    assert all(r["points"] == (d[:, r["sid"]] <= r["radius"]).sum() for r in rings if r["radius"]) and len(rings) == 41 * 9


def test_a_crowd_costs_its_sites_not_its_pairs(spark):
    """Everything in one cell: four times the spots give the same rows per site."""
    rows = []
    for n in (1500, 6000):
        spots, at = crowd(3, n, 40.0), crowd(4, 60, 40.0)
        sites = spark.createDataFrame(pd.DataFrame({"sid": range(60), "sx": at["x"], "sy": at["y"]}))
        parts = spatial._partial_totals(spark.createDataFrame(spots), sites, 200.0, ["n"], lambda d: F.when(d <= 200.0, 1))
        rows.append(parts.count())
        assert parts.agg(F.sum("n")).first()[0] == 60 * n
    assert rows[1] == rows[0] <= 60 * 4


def test_several_weights_ride_on_one_spread(spark):
    a, b = scattered(8, 120), scattered(9, 30)
    rng = np.random.default_rng(5)
    a["w"], a["v"] = rng.uniform(1, 5, len(a)), rng.uniform(0, 2, len(a))
    a.loc[::7, "v"] = np.nan
    rows = spark.createDataFrame(a).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    places = sites_of(spark, b).drop("k")
    both = {r["sid"]: r for r in demand.spread(rows, places, 150.0, ["w", "v"]).collect()}
    for name in ("w", "v"):
        alone = demand.spread(rows, places, 150.0, name).collect()
        assert {r["sid"]: pytest.approx(r["received"]) for r in alone} == {k: r[f"received_{name}"] for k, r in both.items()}


def test_radius_pairs_shuffle_the_copies_of_the_sites(spark, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="10m")
    a, b = scattered(21, 60), scattered(22, 50)
    pairs = spatial.pairs_within(spark.createDataFrame(a).select("id", "x", "y"), sites_of(spark, b).drop("k"), 200.0)
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().sparkPlan().toString() + pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == sum(np.hypot(b.x - r.x, b.y - r.y).le(200.0).sum() for r in a.itertuples())


def test_radius_join_counts_every_copy_of_a_spot(spark, tmp_path):
    people = pd.DataFrame({"c_custkey": [1, 1, 28501, 2], "c_nationkey": pd.array([3, 3, 3, 4], dtype="int32"), "c_acctbal": 1.0, "c_mktsegment": "x"})
    people.to_parquet(tmp_path / "customer.parquet")
    parts = pd.DataFrame({"p_partkey": [-28, -28, 28472], "p_name": "n", "p_brand": "b", "p_type": "t"})  # all stand where agent 1 stands
    parts.to_parquet(tmp_path / "part.parquet")
    got = {r["area"]: (r["pairs"], r["metres"]) for r in radius_join(spark, str(tmp_path)).collect()}
    assert got[3] == (9, 0.0)
