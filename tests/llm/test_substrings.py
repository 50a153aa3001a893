import random
import re

import numpy as np
import pytest

from hostelry.llm import substrings

SCHEMA = "doc_id long, text string, kept string, chunk_ int"


def plain(rows, width=13):
    first, split = {}, []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        split.append((i, words))
        key = i if i is not None else float("inf")
        for k in range(len(words) - width + 1):
            w = tuple(words[k:k + width])
            first[w] = min(first.get(w, key), key)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - width + 1):
            if first[tuple(words[k:k + width])] < (i if i is not None else float("inf")):
                gone |= set(range(k, k + width))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in substrings.remove_repeats(df, **more).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "中文", "the", "the"]
    passages = [rng.choices(vocabulary, k=rng.randint(10, 60)) for _ in range(12)]
    made = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else rng.choices(vocabulary, k=rng.randint(1, 30))
        made.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return made + [(3, made[7][1]), (3, made[7][1]), (None, made[9][1]), (None, None), (500, ""), (501, None), (502, "a " * 300), (503, "a " * 300)]


@pytest.mark.parametrize("more", [{}, {"chunk_chars": 900, "block_chars": 1500}, {"chunk_chars": 900, "cells_per_window": 1, "depth": 1}])
def test_equals_a_plain_search(spark, rows, more):
    assert run(spark, rows, **more) == plain(rows)


def test_other_widths_and_shuffled_rows(spark, rows):
    mixed = list(rows)
    random.Random(1).shuffle(mixed)
    assert run(spark, mixed, width=3, chunk_chars=2000) == plain(rows, 3)


def test_a_passage_that_every_document_has(spark):
    common = " ".join(f"c{i}" for i in range(20))
    rows = [(i, f"u{i} {common} v{i}") for i in range(300)]
    assert run(spark, rows, chunk_chars=700) == plain(rows)


def test_empty_table(spark):
    assert run(spark, [(1, "x")][:0]) == []


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(120_000))
    rows = [(1, long), (2, long[:60_000])]
    assert run(spark, rows, chunk_chars=100_000) == plain(rows)


def test_packing_keeps_any_gaps():
    rng = np.random.default_rng(2)
    sets = [[], [0], [0, 1, 255, 256, 70_000, 2**33, 2**62], *(sorted({*rng.integers(0, 10**k, 500).tolist()}) for k in (3, 6, 12, 18))]
    for values in sets:
        cells = np.array(values, np.uint64)
        assert substrings._unpack(substrings._pack(cells)).tolist() == values
    for values in ([], [0, -1], [127, -128], [128], [2**31 - 1], [2**63 - 1, -5]):
        assert substrings._wide(substrings._narrow(np.array(values, np.int64))).tolist() == values


def test_windows_whose_first_hashes_agree_stay_apart(spark, rows, monkeypatch):
    real = substrings.shingles
    monkeypatch.setattr(substrings, "shingles", lambda h, d, n: (lambda out: (out[0] % np.uint64(5), out[1]))(real(h, d, n)))
    import pyarrow as pa

    table = pa.table({"id_": pa.array([1, 2]), "text_": ["a b c d e f", "x b c d e g"]})
    chunk = substrings._Chunk(table, 3)
    chunk.two = real(chunk.own, chunk.words.doc, 3)[0]
    order, starts, first = chunk.groups(np.arange(len(chunk.one)))
    assert len(starts) == 6 and sorted(first.tolist()) == [0, 1, 2, 3, 4, 7]
