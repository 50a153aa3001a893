import random

import numpy as np
import pytest

from hostelry.llm import decontamination as dc

DOCS, ITEMS = "doc_id long, text string, key_ string, found_ int", "item_id long, text string, id_ int"


def plain_align(a, b):
    """Smith-Waterman by the textbook; words as strings."""
    table = np.zeros((len(a) + 1, len(b) + 1))
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            same = 2 if x == y else 1 if x[:4] == y[:4] else -1
            table[i, j] = max(0, table[i - 1, j - 1] + same, table[i - 1, j] - 1, table[i, j - 1] - 1)
    return table.max()


def coded(words):
    return dc._item_words(" ".join(words)) if words else np.zeros((0, 2), np.uint64)


def test_alignment_equals_the_textbook():
    rng = random.Random(3)
    vocabulary = ["alpha", "alphabet", "beta", "gamma", "delta", "of", "the"]
    one = [rng.choices(vocabulary, k=rng.randint(1, 15)) for _ in range(120)]
    other = [rng.choices(vocabulary, k=rng.randint(0, 25)) for _ in range(120)]
    got = dc.align([coded(x) for x in one], [coded(x) for x in other])
    assert got.tolist() == [plain_align(x, y) for x, y in zip(one, other, strict=True)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = [f"word{i}" for i in range(4000)] + ["the", "of", "and"] * 300
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 50)))) for i in range(30)]
    docs, truth = [], set()
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(0, 200))
        if i % 8 == 0:
            item, text = items[rng.randrange(30)]
            part = text.split()
            kind = i // 8 % 4
            if kind == 1:
                part = [w.upper() + "," for w in part]
            if kind == 2:  # every eighth word replaced
                part = [w if k % 8 else "changed" for k, w in enumerate(part)]
            if kind == 3:  # words dropped and put in
                part = [x for k, w in enumerate(part) for x in ([] if k % 11 == 5 else [w, "extra"] if k % 9 == 4 else [w])]
            at = rng.randint(0, len(words))
            words[at:at] = part
            truth.add((i, item))
        docs.append((i, " ".join(words)))
    return docs, items, truth


def run(spark, docs, items, **more):
    found = dc.find(spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS), **more)
    return {(r.doc_id, r.item_id): r.score for r in found.collect()}


def test_copies_and_edited_copies_are_found_and_nothing_else(spark, corpus):
    docs, items, truth = corpus
    got = run(spark, docs, items)
    assert set(got) == truth
    words = {i: t.lower().replace(",", "").split() for i, t in docs}
    for (doc, item), score in got.items():
        part = dict(items)[item].split()
        assert score == pytest.approx(plain_align(part, words[doc]) / (2 * len(part)))


def test_a_passage_in_most_documents_is_found_in_all(spark, corpus):
    docs, items, _ = corpus
    text = items[4][1]
    hot = [(i, f"{t} {text} tail") for i, t in docs]
    got = run(spark, hot, items)
    assert {i for i, item in got if item == 4} == {i for i, _ in docs}


def test_rows_of_any_kind(spark, corpus):
    _, items, _ = corpus
    text = items[0][1]
    docs = [(1, text), (1, text), (None, text), (3, None), (4, ""), (5, text + " " + "pad " * 50_000 + text)]
    odd = [*items, items[0], (None, text), (99, None), (98, "two words"), (97, "")]
    got = run(spark, docs, odd)
    assert set(got) == {(i, k) for i in (1, None, 5) for k in (0, None)} and set(got.values()) == {1.0}
    assert run(spark, [], items) == {} == run(spark, docs, [])


def test_remove_keeps_columns_and_clean_rows(spark, corpus):
    docs, items, truth = corpus
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in [*docs, (None, "clean"), (7, docs[7][1])]], DOCS)
    left = dc.remove(table, spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS))
    assert left.columns == table.columns
    bad = {i for i, _ in truth}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i in [*(i for i, _ in docs if i not in bad), None, 7])


def test_every_verbatim_passage_of_the_tables_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.find(docs, items).collect()}
    texts = {r.item_id: f" {' '.join(r.text.split())} " for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in f" {' '.join(r.text.split())} "}
    assert want and want <= got
    assert len({d for d, _ in got}) < 0.05 * docs.count()


@pytest.mark.parametrize("copies", [2, 2000])
def test_an_edited_copy_that_many_documents_share_is_found_in_all(spark, copies):
    rng = random.Random(11)
    item = [f"w{i}q" for i in range(39)]
    edited = " ".join(w if k % 4 != 3 else f"other{k}" for k, w in enumerate(item))
    pad = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))) for _ in range(copies + 300)]
    docs = [(i, f"{t} {edited} {t}" if i < copies else t) for i, t in enumerate(pad)]
    got = run(spark, docs, [(0, " ".join(item))])
    assert set(got) == {(i, 0) for i in range(copies)}
    assert set(got.values()) == {plain_align(item, edited.split()) / (2 * len(item))}


def test_a_copy_with_inflected_words_is_found(spark):
    item = [f"{chr(97 + i // 6)}{chr(97 + i % 6)}stem{i}" for i in range(30)]
    inflected = [f"{w}ing" if k % 3 == 1 else w for k, w in enumerate(item)]
    pad = [f"pad{i}" for i in range(40)]
    docs = [(0, " ".join([*pad, *inflected, *pad])), (1, " ".join(pad))]
    assert run(spark, docs, [(0, " ".join(item))]) == {(0, 0): pytest.approx(50 / 60)}
    short = item[:5]  # three 3-grams, none of whole words
    assert run(spark, [(0, " ".join(["be", *(f"{w}ed" if k in (1, 3) else w for k, w in enumerate(short)), "so"]))], [(0, " ".join(short))]) == {
        (0, 0): pytest.approx(8 / 10)}


def test_a_giant_item_lengthens_no_other_passage(spark, corpus):
    docs, items, truth = corpus
    rng = random.Random(13)
    giant = " ".join(f"giant{rng.randrange(10**6)}" for _ in range(4_000))
    docs = [*docs, (1000, f"{docs[3][1]} {giant} {docs[5][1]}"), (1001, "pad " * 3000 + items[2][1] + " pad" * 3000)]
    items = [*items, (50, giant)]
    assert set(run(spark, docs, items)) == truth | {(1000, 50), (1001, 2)}
    seeds = dc.seeds_of(spark.createDataFrame([(i, t) for i, t in items], "key_ long, text string"), "text", dc.SEED).persist()
    slim = spark.createDataFrame(docs, "id_ long, text_ string").where("id_ <> 1000")
    assert all(len(r.text_.split()) < 600 for r in dc._passages(slim, dc.reach_table(seeds, dc.SEED), dc.SEED, 1).collect())


def test_runs_keep_all_hits_together_that_reach_each_other():
    rng = np.random.default_rng(5)
    for _ in range(300):
        place = np.sort(rng.integers(0, 200, rng.integers(1, 15)))
        reach = 2 ** rng.integers(0, 7, len(place))
        part = np.zeros(len(place), int)
        part[dc.runs(np.zeros(len(place)), place - reach, place, place + reach)] = 1
        part = np.cumsum(part)
        for i in range(len(place)):
            for j in range(i):
                assert part[i] == part[j] or place[i] - place[j] > min(reach[i], reach[j])


@pytest.mark.parametrize("changed", [0.1, 0.2, 0.3])
def test_recall_of_edited_copies_against_alignment_of_every_pair(spark, changed):
    rng = random.Random(int(changed * 100))
    vocabulary = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}word" for i in range(3000)] + ["the", "of", "and", "in"] * 150
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 40)))) for i in range(25)]

    def edited(word):
        kind = rng.random()
        if kind > changed:
            return [word]
        return [[], [word, rng.choice(vocabulary)], [word + "ing"], [rng.choice(vocabulary)], [rng.choice(vocabulary)]][rng.randrange(5)]

    docs = []
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.randint(5, 60))
        words[3:3] = [x for w in items[i % 25][1].split() for x in edited(w)]
        docs.append((i, " ".join(words)))
    codes, texts = [dc._item_words(t) for _, t in items], [dc._item_words(t) for _, t in docs]
    truth = set()
    for k, code in enumerate(codes):
        scores = dc.align([code] * len(docs), texts) / (2 * len(code))
        truth |= {(docs[i][0], items[k][0]) for i in np.flatnonzero(scores >= dc.THRESHOLD)}
    got = set(run(spark, docs, items))
    assert got <= truth and len(truth) >= 100
    recall = len(got) / len(truth)
    print(f"recall at {changed}: {recall:.3f} of {len(truth)}")
    assert recall >= 0.9


def test_pairs_of_rare_seeds_are_all_pairs_with_enough_seeds(spark):
    rng = random.Random(17)
    hot = list(range(6))  # seeds that most passages and items have
    items = {i: rng.sample(range(6, 200), rng.randint(0, 14)) + rng.sample(hot, rng.randint(0, 6)) for i in range(40)}
    entries = [(i, seed, rng.random() < 0.5, at) for i, own in items.items() for at, seed in enumerate(own)]
    usual = [(i, min(2, len(own)), max(min(2, len(own)), -(-len(own) // dc.BEGUN_SHARE))) for i, own in items.items() if own]
    hits = [(k, seed, at) for k in range(300) for at, seed in enumerate(rng.sample(range(200), 12) + rng.sample(hot, rng.randint(0, 6)))]
    seeds = spark.createDataFrame(entries, "key_ long, seed_ long, whole_ boolean, at_ int")
    each = spark.createDataFrame(hits, "key_ long, seed_ long, place_ int")
    wanted = dc.with_rarity(seeds, spark.createDataFrame(usual, "key_ long, need_ long, many_ long"), each).persist()
    got = {(r.key_, r.item_key_): sorted(tuple(p) for p in r.places_) for r in dc._pairs(each, wanted).collect()}

    bounds, of = {i: (need, many) for i, need, many in usual}, {}
    for i, seed, whole, at in entries:
        of.setdefault(seed, []).append((i, at, whole))
    met = {}
    for k, seed, place in hits:
        for i, at, whole in of.get(seed, ()):
            met.setdefault((k, i), []).append((place, at, whole))
    want = {pair: sorted(p) for pair, p in met.items() if len({at for _, at, whole in p if whole}) >= bounds[pair[1]][0]
            or len({at for _, at, _ in p}) >= bounds[pair[1]][1]}
    assert got == want and want
    times = {seed: sum(s == seed for _, s, _ in hits) for seed in range(200)}
    rows = wanted.collect()
    for i, (need, many) in bounds.items():
        for whole in (True, False):
            own = [r for r in rows if r.item_key_ == i and r.whole_ == whole]
            common = [times[r.seed_] for r in own if r.common_]
            assert len(common) == min(len(own), need - 1 if whole else many - need)
            assert not common or min(common) >= max((times[r.seed_] for r in own if not r.common_), default=0)
