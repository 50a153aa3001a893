import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from hostelry.llm import crf, quality, queries

SF = "/root/testdata/sf0.01"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, twins = set(), 0
    for x in lines:
        twins += x in seen
        seen.add(x)
    threes = list(zip(words, words[1:], words[2:]))
    count, covered = Counter(threes), set()
    for i, w in enumerate(threes):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), twins, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def blank_chain():
    return crf.train(np.zeros((0, len(quality._SHARES)), int), np.zeros(0, int), np.array([0]), int(quality._OFFSETS[-1]), 2)


def measured(texts):
    per = quality.measure(texts).per_text
    return list(zip(*(per[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))


def test_statistics_equal_a_plain_count():
    rng = random.Random(8)
    parts = ["a", "b", "the", "é", "中文", "#*", "\n", " ", "\t", "\r\n", "x|y", "\x0b", "\xa0", "<b>", "\n\n", "\x85"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 200))) for _ in range(600)] + ["", "\n", " ", "a a a a a a"]
    assert measured(texts) == [plain(t)[:5] for t in texts]


@pytest.fixture(scope="module")
def judged(spark):
    out = queries.op9_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return out, labels, texts


def test_query_equals_a_plain_count_on_the_tables(judged):
    out, _, texts = judged
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(texts[r.doc_id])


def test_verdicts_agree_with_labels(judged):
    out, labels, _ = judged
    pairs = [(labels[r.doc_id], r.kept) for r in out if r.doc_id in labels and not r.base_failed]
    assert sum(bool(a) == b for a, b in pairs) > 0.95 * len(pairs)


def test_held_out_verdicts_agree_with_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    pairs = [(held[r.doc_id], r.kept) for r in quality.judge(docs, chain).collect() if r.doc_id in held and not r.base_failed]
    assert sum(bool(a) == b for a, b in pairs) > 0.9 * len(pairs)


def test_rows_of_any_kind(spark):
    text = "word " * 10 + " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([
        Row(doc_id=1, text=text, kept="x"), Row(doc_id=1, text=text, kept="x"), Row(doc_id=None, text=None, kept=None), Row(doc_id=3, text="", kept="")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    chain = quality.fit(docs, labels)
    out = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality.judge(docs, chain).collect())
    assert out == [(0, 0, True, False), (1, 90, False, True), (1, 90, False, True), (3, 0, True, False)]
    assert quality.judge(docs.limit(0), chain).collect() == []
    assert not quality.fit(docs, labels.limit(0)).weights.any()


def test_a_very_long_line_and_many_lines():
    assert measured(["ab " * 200_000, "a b\n" * 50_000]) == [plain("ab " * 200_000)[:5], plain("a b\n" * 50_000)[:5]]
    lines = quality.measure(["a b\n" * 20_000])
    assert len(blank_chain().decode(lines.features, lines.first(1))) == 20_000


def test_halves_of_mixed_texts_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = quality.fit(docs, labels)
    rows = docs.join(labels, "doc_id").where("length(text) > 400").orderBy("doc_id").collect()
    good, bad = ([r.text.strip("\n") for r in rows if r.quality == q and r.text.count("\n") >= 4][:30] for q in (1, 0))
    mixed = [f"{a}\n{b}" if i % 2 else f"{b}\n{a}" for i, (a, b) in enumerate(zip(good, bad))]
    lines = quality.measure(mixed)
    marks, first = chain.decode(lines.features, lines.first(len(mixed))), lines.first(len(mixed))
    wrong = {0: [], 1: []}
    for i, (a, b) in enumerate(zip(good, bad)):
        own, n = marks[first[i]:first[i + 1]], sum(bool(x.split()) for x in (a if i % 2 else b).split("\n"))
        head, tail = (0, 1) if i % 2 else (1, 0)
        wrong[head] += list(own[:n] != head)
        wrong[tail] += list(own[n:] != tail)
    assert len(mixed) > 10 and np.mean(wrong[0]) < 0.1 and np.mean(wrong[1]) < 0.2


def test_training_is_bounded_in_runs_and_takes_an_id_once(spark):
    docs = spark.createDataFrame([(1, "a b\n" * 4000), (1, "c d\n" * 4000), (2, "#*\n" * 500), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    once = quality.fit(docs.where("text is null or not text like 'c%'"), labels)
    assert np.array_equal(quality.fit(docs, labels).weights, once.weights)
    assert quality.fit(docs, labels, max_sequences=5).weights.any()
