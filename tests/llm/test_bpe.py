import base64
import hashlib
import random

import numpy as np
import public_tokenizers as vocabularies
import pytest
import tiktoken
from pyspark.sql import Row

from hostelry.llm import bpe

PATH, PATTERN = vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.load(PATH), PATTERN)


def unpacked(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_equals_the_library_on_every_kind_of_text(codec, library):
    rng = random.Random(3)
    signs = "aeiou stnrl'0123 \n\t.,!?éü中م‍\U0001f600%$#"
    texts = ["", " ", "\n\n x", "don't", "a" * 3000, " " * 999 + "x", "ab" * 700, "é" * 333, "<|endoftext|>"]
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 90))) for _ in range(800)]
    for text, packed in zip(texts, codec.encode(texts), strict=True):
        assert unpacked(packed) == library.encode_ordinary(text), text
        assert codec.decode(packed) == text.encode()


def test_equals_the_library_on_letters_of_the_basic_plane(codec, library):
    texts = [f"a{chr(c)} {chr(c)}1" for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    packed = codec.encode(texts)
    assert [unpacked(p) for p in packed[::17]] == [library.encode_ordinary(t) for t in texts[::17]]


def test_long_and_short_trees_agree(codec):
    rng = random.Random(5)
    pieces = ["".join(rng.choices("thenadior", k=rng.randint(2, 60))).encode() for _ in range(400)]
    by_size = {}
    for p in pieces:
        by_size.setdefault((len(p) - 1).bit_length(), []).append(p)
    for group in by_size.values():
        assert [unpacked(x) for x in codec.merge_short(group)] == [codec.merge_long(p) for p in group]


def test_a_full_memo_changes_nothing(codec, monkeypatch):
    texts = [f"word{i} other{i % 7}" for i in range(60)]
    before = codec.encode(texts)
    monkeypatch.setattr(bpe, "MEMO", 10)
    assert codec.encode(texts) == before == codec.encode(texts)


def test_rows_of_any_kind(spark, library):
    rows = [Row(doc_id=1, text="Hello world", ids="x", decoded=1), Row(doc_id=1, text="Hello world", ids="y", decoded=2),
            Row(doc_id=None, text=None, ids=None, decoded=None), Row(doc_id=3, text="", ids="z", decoded=3)]
    out = bpe.round_trip(spark.createDataFrame(rows), PATH, PATTERN)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in out.collect())
    n = len(library.encode_ordinary("Hello world"))
    assert got == [(0, 0, b""), (1, n, b"Hello world"), (1, n, b"Hello world"), (3, 0, b"")]
    digest = {r.doc_id: r for r in bpe.digests(out).collect()}
    ids = np.array(library.encode_ordinary("Hello world"), "<u4").tobytes()
    assert digest[1].ids_sha256 == hashlib.sha256(ids).hexdigest()
    assert digest[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_apart_equals_together_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    apart = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert sorted(apart.collect()) == sorted(bpe.round_trip(docs, PATH, PATTERN).collect())
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).collect() == []
