"""Search by K2-treaps against the score of every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from hostelry.llm import queries, search
from tools.check import rows_of

FOLDER = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        hits = []
        for doc, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                for t in terms(text) if t in bag)
            if score > 0:
                hits.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, h[3], -h[0]) for rank, h in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20):
    out = search.top(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out), key=repr)


def sample(n=400):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "éa", "日本", "x1"]
    text = lambda k: " ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=k))
    docs = [(i, text(rng.choice([0, 3, 20, 90]))) for i in range(n)]
    docs += [(1000 + i, "copy of w7 W9-w11 日本") for i in range(120)]  # equal scores, more than k
    docs += [(None, "w7 w9"), (None, None), (5, "w7 w9"), (5, "w7 w9"), (2000, "w3, " * 60000), (2001, "...")]
    return docs, [(i, text(rng.choice([1, 4, 30]))) for i in range(12)] + [(50, "W7 w9 w9 日本"), (51, ""), (52, None), (53, "absent"), (54, "w1 " * 9)]


@pytest.mark.parametrize("shard,block", [(16384, 200_000), (37, 25)])
def test_matches_the_score_of_every_document(spark, monkeypatch, shard, block):
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    docs, items = sample()
    made = search._postings

    def small(*args):  # the bound is read in Python workers
        return made(*args, shard)

    monkeypatch.setattr(search, "_postings", small)
    assert found(spark, docs, items) == brute(docs, items)


def test_repeated_items_and_few_hits(spark):
    docs, items = sample(60)
    assert found(spark, docs, items[:3], 2) == brute(docs, items[:3], 2)
    doubled = found(spark, docs, [(1, "w1"), (1, "w2")], 3)
    assert [r[:2] for r in doubled] == [(1, 1), (1, 2), (1, 3)]


def test_empty_tables_and_clashing_columns(spark):
    docs, items = sample(30)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None), (2, "--")], items) == []
    wide = spark.createDataFrame([(*d, "x", 3, 4) for d in docs], DOCS + ", item_id string, score int, rank int")
    more = spark.createDataFrame([(*i, "y", 1) for i in items], ITEMS + ", doc_id string, term int")
    got = search.top(wide, more).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == brute(docs, items)


def test_treap_cells_hold_maxima(monkeypatch):
    rng = np.random.default_rng(4)
    cells = np.unique(rng.integers(0, 64 * 4096, 9000))
    rows, cols, impact = cells // 4096, cells % 4096, rng.integers(1, 1000, len(cells))
    treap = search.build(rows, cols, impact, 12)
    assert treap.top[0] == impact.max() and len(treap.top) < 13 * len(cells)
    want = np.zeros(4096, np.int64)
    weights = rng.integers(1, 50, 5)
    for row, w in zip((3, 9, 33, 60, 61), weights):
        np.add.at(want, cols[rows == row], w * impact[rows == row])
    monkeypatch.setattr(search, "BATCH", 8)
    got = search.best(treap, np.array([3, 9, 33, 60, 61]), weights, 10)
    assert got == [(int(want[c]), int(c)) for c in np.lexsort((np.arange(4096), -want))[:10]]


def test_query_matches_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    df = queries.op12_search(spark, FOLDER)
    cursor = db.execute(queries.OP12)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
