import base64

import numpy as np
import public_tokenizers as vocabularies
import pytest
import tiktoken

import corpus_pipeline as pipeline
from hostelry.llm import queries, secrets

from .test_near_duplicates import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        out.append((docs, stage(spark, docs, SF)))
        out[-1][1].write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[-1] = (out[-1][0], docs)
    return out


def test_columns_stay_until_the_last(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [set(after.columns) for _, after in stages[:-1]] == [set(columns)] * 4
    assert stages[-1][1].columns == ["doc_id", "n_tokens", "ids"]


def test_filters_only_take_rows_away(stages):
    for before, after in stages[:3]:
        assert {tuple(r[c] for c in before.columns) for r in after.select(*before.columns).collect()} <= set(map(tuple, before.collect()))


def test_toxic_documents_go_and_most_clean_ones_stay(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in stages[0][1].collect()}
    clean = [i for i, y in labels.items() if not y]
    assert sum(i in left for i in clean) >= 0.97 * len(clean)


def test_one_of_each_class_stays(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert sorted(r.doc_id for r in after.collect()) == [i for i, _, _, kept in plain(rows, 5, 80) if kept]


def test_no_item_is_left(spark, stages):
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: " ".join((r.text or "").split()) for r in t.collect()} for t in stages[2])
    held = {i for i, t in before.items() if any(x in t for x in items)}
    assert not held & set(after) and len(after) >= 0.9 * len(before)


def test_texts_have_no_secret_left(stages):
    before, after = ({r.doc_id: r for r in t.collect()} for t in stages[3])
    assert set(before) == set(after)
    for i, r in after.items():
        found = secrets.scan_texts([before[i].text])[0]
        assert (r.text == before[i].text) == (not found)
        assert r.n_chars == len(r.text) and not any(s[0] in ("access", "hex") for s in secrets.scan_texts([r.text])[0])


def test_tokens_are_those_of_the_library(stages):
    with open(vocabularies.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in stages[4][0].collect()}
    for r in stages[4][1].collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) // 4


def test_run_gives_what_its_stages_give(spark, stages):
    got = queries.QUERIES["pipeline"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
