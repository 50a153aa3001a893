import random
import re

import numpy as np
import pytest

from hostelry.llm import components as cc
from hostelry.llm import near_duplicates as nd

SCHEMA = "doc_id long, text string, kept string, id_ int"


def plain(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append({tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                up[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def run(spark, rows, **more):
    return sorted(tuple(r) for r in nd.classes(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), **more).collect())


def copies(rng, vocabulary, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(vocabulary)
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)] + ["é", "The", "THE"]
    made = []
    for _ in range(14):
        base = rng.choices(vocabulary, k=rng.randint(20, 150))
        made += [copies(rng, vocabulary, base, rng.randint(0, 6)) for _ in range(rng.randint(1, 14))]
    passage = " ".join(rng.choices(vocabulary, k=60))  # alike, but not enough
    made += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(10, 40))) for _ in range(40)]
    made += ["", None, " \n", "one", "ONE", "one two", "a b a b a b a b", "a b a b a b", made[0], made[0].upper(), made[3]]
    ids = list(range(len(made)))
    rng.shuffle(ids)
    return list(zip(ids, made, strict=True))


@pytest.mark.parametrize("more", [{"n": 3, "similarity": 0.85}, {"n": 3, "similarity": 0.85, "block": 3}, {}])
def test_equals_comparing_all_pairs(spark, rows, more):
    assert run(spark, rows, **more) == plain(rows, more.get("n", 5), round(100 * more.get("similarity", 0.8)))


def test_a_large_group_of_edited_copies(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=150)
    rows = [(i, copies(rng, vocabulary, base, rng.randint(1, 9))) for i in range(250)]
    assert run(spark, rows, n=3, similarity=0.85, block=40) == plain(rows, 3, 85)


def test_blocks_of_alike_unlinked_texts_ship_no_texts(spark, monkeypatch):
    rng = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(50))  # similarity about 0.4: some bands are shared, no link is plausible
    rows = [(i, passage + " " + " ".join(f"t{rng.randrange(10**6)}" for _ in range(35))) for i in range(400)]
    sizes, plain = {}, nd._plausible
    monkeypatch.setattr(nd, "_plausible", lambda units, *a: sizes.setdefault("signatures", units.count()) and plain(units, *a))
    verify = nd._verify_blocks
    monkeypatch.setattr(nd, "_verify_blocks", lambda full, *a: sizes.setdefault("texts", full.count()) or verify(full, *a))
    assert [c for _, _, c, _ in run(spark, rows, n=3, similarity=0.85, block=20)] == [i for i, _ in rows]
    assert sizes["signatures"] > 400 and sizes["texts"] < 40


def test_rows_of_any_kind(spark):
    text = " ".join(f"w{i}" for i in range(30))
    assert run(spark, []) == []
    got = nd.classes(spark.createDataFrame([(None, text, "", 0), (4, text, "", 0), (4, text, "", 0), (9, text, "", 0), (None, None, None, None)], SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        (None, 26, None, True), (4, 26, 4, True), (4, 26, 4, True), (9, 26, 4, False), (None, 0, None, True)]))


def test_equal_ids_with_different_texts_have_one_class(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = run(spark, [(4, text), (4, ""), (4, text + " x"), (9, text), (2, "other words here")])
    assert [(i, c) for i, _, c, _ in got] == [(2, 2), (4, 4), (4, 4), (4, 4), (9, 4)]


def test_signatures_estimate_similarity_and_pruning_keeps_true_pairs():
    rng = np.random.default_rng(1)
    least, lost, kept = nd.least_matches(0.85, nd.MISS), 0, 0
    for _ in range(300):
        whole = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = np.sort(whole[:380]), np.sort(whole[30:])  # similarity 0.875
        lost += not len(nd.survivors(nd.signature(a), nd.signature(b)[None], least))
        c = np.sort(rng.integers(0, 2**63, 380, dtype=np.uint64))
        kept += len(nd.survivors(nd.signature(a), nd.signature(c)[None], least))
    assert lost == 0 and kept == 0


def test_components_of_paths_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200, 202: 200}
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []
