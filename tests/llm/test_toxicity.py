import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hostelry.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in queries.op8_toxicity(spark, SF).collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_every_document_has_a_score_and_the_right_part(spark, scored):
    ids = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert sorted(scored) == sorted(ids)
    for i, r in scored.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_held_out_rows_are_ranked_well(scored, labels):
    toxic = [scored[i].score for i, y in labels.items() if scored[i].held_out and y]
    clean = [scored[i].score for i, y in labels.items() if scored[i].held_out and not y]
    wins = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert wins > 0.75
    assert np.mean([c < 0.7 for c in clean]) > 0.95


def test_labels_of_held_out_rows_are_never_read(spark, scored):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.remainder("doc_id") % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, flipped)).collect()}
    assert again == pytest.approx({i: r.score for i, r in scored.items()})


def test_rows_of_any_kind_without_labels_of_both_sorts(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text="YOU id1ot!!!", score="x"), Row(doc_id=1, text="YOU id1ot!!!", score="x"),
                                  Row(doc_id=None, text=None, score=None), Row(doc_id=3, text="", score="")])
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    out = toxicity.score(docs, model)
    assert sorted((r.doc_id or 0, r.score, r.predicted) for r in out.collect()) == [(0, 0.0, 0), (1, 0.0, 0), (1, 0.0, 0), (3, 0.0, 0)]
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert toxicity.fit(docs, none.limit(0)).base == 0


def test_features_say_what_they_should():
    keys = np.sort(toxicity.words_of(["idiot"]).hashes())
    lexicon = toxicity.Lexicon(keys, keys)
    texts = ["you Idiot, stop", "the idiot " + "word " * 30 + "you", "LOUD WORDS!!", "sh1t l0ser", "sooo", "", "x" * 100_000]
    got = {name: toxicity.features(texts, lexicon)[:, i] for i, name in enumerate(toxicity.FEATURES)}
    assert got["strong"][0] == pytest.approx(1 / 3) and got["near_person"][0] == 1
    assert got["strong"][1] == pytest.approx(1 / 33) and got["near_person"][1] == 0
    assert got["capital_words"][2] == 1 and got["shouts"][2] > 0
    assert got["hidden"][3] == 1 and got["stretched"][4] == 1
    assert not any(got[name][5] for name in got)


def plainly(text, known):
    """The twelve features counted word by word."""
    words, tokens = re.findall(r"[^ \t\n\v\f\r]+", text), re.findall(r"[A-Za-z\x80-\U0010ffff]+", text)
    low = [t.translate({c: c + 32 for c in range(65, 91)}) for t in tokens]
    strong = [i for i, t in enumerate(low) if t in known]
    person = [i for i, t in enumerate(low) if t in ("you", "your")]
    size = max(len(text), 1)
    letters = [c for c in text if c.isascii() and c.isalpha()]
    caps = [w for w in words if sum("A" <= c <= "Z" for c in w) >= 2 and not any("a" <= c <= "z" for c in w)]
    return [len(strong) / max(len(tokens), 1), np.log1p(len(strong)), sum(any(abs(p - s) <= toxicity.NEAR for p in person) for s in strong) / max(len(strong), 1),
            len(person) / max(len(tokens), 1), sum("A" <= c <= "Z" for c in letters) / max(len(letters), 1), len(caps) / max(len(words), 1),
            text.count("!") / size, np.log1p(len(words))]


def test_features_against_a_plain_count():
    rng = random.Random(4)
    known = ["idiot", "loser"]
    keys = np.sort(toxicity.words_of(known).hashes())
    texts = [" ".join(rng.choices(["you", "Your", "idiot", "LOSER", "fine", "WORDS", "a", "end!", "so,", "IDIOT!"], k=rng.randrange(0, 40))) for _ in range(300)]
    got = toxicity.features(texts, toxicity.Lexicon(keys, keys))
    names = ["strong", "log_strong", "near_person", "person", "capitals", "capital_words", "shouts", "log_words"]
    at = [0, 2, 3, 4, 5, 6, 7, 11]
    for row, text in zip(got, texts):
        assert row[at] == pytest.approx(plainly(text, known)), (names, text)


def test_an_id_with_many_texts_counts_once(spark):
    texts = [(i, ("you vile idiot " if i % 2 else "a fine day ") * 5 + str(i)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    one = spark.createDataFrame(texts, "doc_id long, text string")
    many = spark.createDataFrame(texts + [(i, t + " zz") for i, t in texts if i % 2] * 3, "doc_id long, text string")
    sizes = [toxicity._labelled(d, labels, "doc_id", "text", "toxic", 100).count() for d in (one, many)]
    assert sizes[0] == sizes[1] <= 60
