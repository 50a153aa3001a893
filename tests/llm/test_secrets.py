import base64
import gzip
import hashlib
import random
import re
import time
import zlib
from urllib.parse import quote

import pytest
from pyspark.sql import Row

from hostelry.llm import secrets, spans

PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
               lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def plain(text):
    out = [(k, m.start(), m.end()) for k, (p, good) in PATTERNS.items() for m in p.finditer(text) if good(m)]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def base(text):
    return [s[:3] for s in secrets.scan_texts([text])[0] if s[3]]


def hidden(text):
    return {text[a:b] for _, a, b, own in secrets.scan_texts([text])[0] if not own}


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["password", "passwd", "TOKEN", "Secret", "api_key", "apikey", "=", ": ", '"', "'", " ", "AKIA", "\n", "é", "中",
             "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "hunter2", "x", ".", "token=", "==", "AK", "  = "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)]
    found = secrets.scan_texts(texts)
    for text, spans_ in zip(texts, found, strict=True):
        assert [s[:3] for s in spans_ if s[3]] == plain(text), text


def test_layers_are_unwrapped_to_the_last():
    core = 'token = "hunter2hunter2"'
    layers = [quote(core, safe=""), "".join(f"\\u{ord(c):04x}" for c in core), base64.b64encode(core.encode()).decode(),
              base64.b64encode(zlib.compress(core.encode())).decode(), base64.b64encode(gzip.compress(gzip.compress(core.encode()))).decode(),
              base64.urlsafe_b64encode(base64.b64encode(quote(core, safe="").encode())).decode(),
              quote(base64.b64encode(zlib.compress(core.encode())).decode(), safe="")]
    for layer in layers:
        assert base(f"é see {layer} end") == plain(f"é see {layer} end")
        # an escape of the closing quote is not part of the find
        assert any(layer.startswith(h) and len(h) >= len(layer) - 6 for h in hidden(f"é see {layer} end")), layer


def test_a_half_encoded_assignment_spans_both_parts():
    assert hidden("my password=%68%75nter2%68x end") == {"password=%68%75nter2%68x"}
    assert hidden("my password: %68%75%6e%74%65%72%32") == {"password: %68%75%6e%74%65%72%32"}


def test_plain_text_and_broken_codes_add_nothing():
    for text in ["100% of%%% it", "%zz \\u12 aGVsbG8gd29ybGQgdGhpcyBpcw== fine", "deadbeef" * 5, "A" * 5000, "%41" * 3000, ""]:
        assert all(s[3] for s in secrets.scan_texts([text])[0]), text


def test_a_cycle_ends(monkeypatch):
    flips = {"ping": "pong", "pong": "ping"}
    monkeypatch.setattr(secrets, "decoded_runs", lambda t, _: [(0, 4, flips[t[:4]])])
    assert secrets.hidden_spans("ping") == set()


def test_a_run_over_the_layer_bound_is_read_as_a_stream():
    """What gave only a span of kind oversize is now scanned whole."""
    for at in (0, 999, 50_000, 99_990):
        body = bytearray(b"z" * 100_000)
        body[at:at] = b" password=hunter2222 "
        bomb = base64.b64encode(zlib.compress(bytes(body))).decode()
        assert ("assign", 2, 2 + len(bomb), False) in secrets.scan_texts([f"x {bomb}"], limit=8192)[0]


def test_bytes_that_are_no_text_and_wrapped_base64():
    noise = bytes(range(128, 188))
    run = base64.b64encode(noise + b"password=hunter2222 " + noise).decode()
    assert secrets.scan_texts([run]) == [[("assign", 0, len(run), False)]]
    inner = base64.b64encode(noise + run.encode() + b" " + noise).decode()
    assert secrets.scan_texts([inner]) == [[("assign", 0, len(inner), False)]]
    plain = base64.b64encode(b"Dear reader, the password=hunter2222 is set. Yours, the keeper of the keys").decode()
    for width, end in ((40, "\n"), (41, "\r\n"), (17, "\n  ")):
        lines = end.join(plain[i:i + width] for i in range(0, len(plain), width))
        assert secrets.scan_texts([f"key:\n{lines}\nend"]) == [[("assign", 5, 5 + len(lines), False)]]


@pytest.mark.parametrize("text", [
    "%" + "25" * 50_000 + "41", "a &" + "#38;" * 30_000 + "#37;41", "\\" + "x5c" * 33_000 + "x41", "%26#37;" + "26#37;" * 16_000 + "41",
    "A" * 100_000, "%" * 100_000, "%4" * 50_000, "QUFB" * 25_000, ("A" * 20 + "\n") * 5_000])
def test_long_chains_take_linear_time(text):
    start = time.perf_counter()
    secrets.scan_texts([text])
    assert time.perf_counter() - start < 5


def test_a_chain_is_followed_to_its_end():
    for hidden in ("password%25252525253Dhunter2222", "pass%26#37;26#37;26#37;77ord=hunter2222", "password&#38;#38;#61;hunter2222", "password\\x5cx5cx3dhunter2222"):
        assert [s[0] for s in secrets.scan_texts([f"see {hidden} ok"])[0]] == ["assign"]


def test_rows_of_any_kind(spark):
    text = 'a token = "abcdefgh" b'
    rows = [Row(doc_id=1, text=text, spans=1), Row(doc_id=1, text=text, spans=2), Row(doc_id=None, text=None, spans=None),
            Row(doc_id=4, text="", spans=4)]
    docs = spark.createDataFrame(rows)
    out = spans.digests(secrets.scan(docs), secrets.KINDS).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_assign, r.spans) for r in out) == [(0, 0, ""), (1, 1, "assign:2:19"), (1, 1, "assign:2:19"), (4, 0, "")]
    assert {r.base_sha256 for r in out if r.doc_id != 1} == {empty}
    assert {r.base_sha256 for r in out if r.doc_id == 1} == {hashlib.sha256(b"assign:2:19").hexdigest()}
    cleaned = secrets.redact(docs)
    assert cleaned.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in cleaned.collect() if r.text is not None) == [
        (1, 'a [SECRET]" b'), (1, 'a [SECRET]" b'), (4, "")]
    assert secrets.scan(docs.limit(0)).collect() == [] == secrets.redact(docs.limit(0)).collect()


def test_a_very_long_text():
    text = "word " * 300_000 + 'secret: "0123456789abcdef0123456789abcdef"'
    assert [s[0] for s in secrets.scan_texts([text])[0]] == ["assign", "hex"]


def test_every_member_of_a_compressed_run_is_read_also_if_cut_off():
    core = b"some plain words and then password = hunter2hunter2 end"
    for packed in (gzip.compress(b"first member, ") + gzip.compress(core), gzip.compress(core)[:-9], zlib.compress(core)[:-4]):
        text = base64.b64encode(packed).decode()
        assert {kind for kind, _, _ in secrets.hidden_spans(text)} == {"assign"}
