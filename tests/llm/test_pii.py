import hashlib
import random
import re
import time

import pytest
from pyspark.sql import Row

from hostelry.llm import pii, spans


@pytest.fixture(scope="module")
def chain():
    return pii.train()


def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def digits(text):
    return re.sub(r"[^0-9]", "", text)


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(digits(t)) <= 19 and luhn(digits(t))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
}


def plain(text):
    out = [(k, m.start(), m.end()) for k, (p, good) in PATTERNS.items() for m in re.finditer(p, text) if good(m[0])]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns(chain):
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@x", "mail.com", ".", "-", " ", "+", "+4", "(", ")", "1", "12", "255", "256", "000", "4111111111111111",
             "1.2.3.4", "é", "中", "\n", "%", "_", "378282246310005", "5555 5555 5555 4444", "+1 (499) 555-6503", "\t"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)]
    for text, found in zip(texts, pii.find(texts, chain), strict=True):
        assert [s[:3] for s in found if s[3]] == plain(text), text


def test_the_field_finds_its_examples_and_forms_like_them(chain):
    hits = wanted = 0
    for line in pii.EXAMPLES:
        want = {m[2] for m in re.finditer(r"<(\w+)>(.*?)</\1>", line)}
        clean = re.sub(r"</?(?:email|ip|card|phone)>", "", line)
        got = {clean[a:b] for _, a, b, own in pii.find([clean], chain)[0] if not own}
        hits += len(want & got)
        wanted += len(want)
    assert hits >= 0.85 * wanted
    new = ["please call (415) 555-2671 tomorrow", "write to peter at mail dot org today", "node 10[.]20[.]30[.]40 is up"]
    assert all(any(not s[3] for s in found) for found in pii.find(new, chain))


def test_plain_prose_gets_nothing(chain):
    texts = ["In 1999 we sold 12,500 units at 3.50 each.", "Anat with by of nteres atre are.", "1 2 3 4 5 6 7", "", "%%% *** 12"]
    assert not any(pii.find(texts, chain))


def test_added_spans_never_touch_base_spans(chain):
    rng = random.Random(4)
    parts = ["555-123-4567", "a@b.com", "tel", "+49 30 901820 11", "4111.1111.1111.1111", "at", "dot", "1.2.3.4", "call", "john", "com"]
    for text in (" ".join(rng.choices(parts, k=12)) for _ in range(300)):
        found = pii.find([text], chain)[0]
        own = [s for s in found if s[3]]
        assert not any(a < y and x < b for _, a, b, base in found if not base for _, x, y, _ in own)


def test_rows_of_any_kind(spark):
    text = "é a.b@c.de x"
    docs = spark.createDataFrame([
        Row(doc_id=1, text=text, spans=1), Row(doc_id=1, text=text, spans=1), Row(doc_id=None, text=None, spans=None),
        Row(doc_id=3, text="", spans=2)])
    out = spans.digests(pii.scan(docs), pii.KINDS).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_phone, r.spans) for r in out) == [
        (0, 0, 0, ""), (1, 1, 0, "email:2:10"), (1, 1, 0, "email:2:10"), (3, 0, 0, "")]
    assert {r.base_sha256 for r in out if r.doc_id == 1} == {hashlib.sha256(b"email:2:10").hexdigest()}
    assert pii.scan(docs.limit(0)).collect() == []


def test_long_runs_take_linear_time(chain):
    for text in ["1" * 300_000, "a" * 300_000, "1." * 100_000, "a@" * 50_000, "+1" * 50_000, "1 " * 200_000]:
        pii.find([text], chain)


def test_without_examples_only_the_patterns_count(spark):
    docs = spark.createDataFrame([(1, "call (499) 555-6503 or a@b.de")], "doc_id long, text string")
    assert [s.kind for s in pii.scan(docs, examples=[]).first().spans] == ["email"]


def test_labelled_runs_are_judged_in_linear_time():
    start = time.perf_counter()
    for tail in ("-dot" * 25_000 + " § dot com", " dot a" * 16_000 + " §", "-at" * 30_000, " " * 100_000 + "§", ".a" * 50_000 + "§"):
        for kind in ("email", "ip", "card", "phone"):
            assert not pii.possible(kind, "john at mail" + tail)
    assert time.perf_counter() - start < 5
    for part in ("john at mail dot com", "john.s [at] mail(dot)com", "a@b.co", "j_d  at  x-y . org"):
        assert pii.possible("email", part)
