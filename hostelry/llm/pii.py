"""Personal data in texts: four patterns, and a conditional random field over word shapes.

The patterns give the base spans. The field adds spellings that no pattern has: mail addresses written with
words, telephone numbers without a plus, cards and addresses with other separators. It reads windows of words
around every word with a digit, an @, a bracketed "at" or a spelled-out dot, labels them by Viterbi in numpy batches, and a
labelled run counts only if its letters and digits are possible for its kind. Spans of the field never
overlap base spans.

The field is trained from ``EXAMPLES`` or a table of the same form, which must stay small.

Cases: null and empty texts have no spans; repeated rows give repeated results; an empty table gives an empty
table; other columns are not read; very long texts are read whole, in linear time.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hostelry.llm import crf
from hostelry.llm.frames import per_document
from hostelry.llm.spans import SPAN, code_points, in_order
from hostelry.llm.words import LOWER, Words, words_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
#: Words read on each side of a word that may be part of a span.
AROUND = 5

_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = np.zeros(256, bool)
_LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True

# Labelled lines, marked by kind.
EXAMPLES = """
write to <email>john at mail dot com</email> today
contact <email>anna.lee (at) example (dot) org</email> for details
reach me: <email>bob [at] corp [dot] net</email>
my address is <email>maria_k at uni dot edu dot au</email> thanks
<email>sales {at} shop {dot} de</email> answers
mail <email>info(at)firm.fr</email> or call
send it to <email>k.mayer[at]post.example.de</email> please
write <email>joe99 AT gmail DOT com</email> about it
contact <email>the.editor at paper dot co dot uk</email> by 10 May
call <phone>(499) 555-6503</phone> after 6
tel <phone>555-123-4567</phone> or write
phone: <phone>0221 / 123 45 67</phone> daily
ring <phone>(020) 7946 0018</phone> before noon
fax <phone>01 42 68 53 00</phone> in Paris
mobile <phone>07700 900123</phone> only
Tel. <phone>030-901820</phone> Berlin
call <phone>1-800-555-0199</phone> free of charge
phone <phone>555.867.5309</phone> for Jenny
dial <phone>(0)30 1234567</phone> now
number <phone>00 49 30 901820</phone> abroad
telephone <phone>(212) 555 0147</phone> , ext 12
card <card>4111.1111.1111.1111</card> valid
visa <card>4111_1111_1111_1111</card> expires 12/27
paid with <card>5500/0000/0000/0004</card> yesterday
card number: <card>3782.822463.10005</card> amex
mastercard <card>5555 . 5555 . 5555 . 4444</card> ok
card no <card>4012–8888–8888–1881</card> please
server <ip>192-168-0-12</ip> is down
address <ip>10 . 0 . 0 . 7</ip> answered
ip <ip>172[.]16[.]254[.]1</ip> blocked
from <ip>fe80::1ff:fe23:4567:890a</ip> port 80
host <ip>2001:db8:85a3::8a2e:370:7334</ip> replied
seen at <ip>203(dot)0(dot)113(dot)9</ip> again
ping <ip>8[.]8[.]4[.]4</ip> twice
in 1999 and 2004 we sold 12,500 units at 3.50 each
version 2.0.1 of the License, 2nd edition
on 2024-05-17 at 10:30:00 the meeting of 12 began
pages 120-134 , vol. 12 , no. 3
it costs $1,299.00 or 1.299,00 EUR in 2023
room 101 on floor 3 at 5 o'clock
between 1914 - 1918 and 1939 - 1945
the dot on the map at noon is 3 cm wide
ISBN 978-3-16-148410-0 printed 2001
order 20240517-000123 shipped 17.05.2024
look at the dot product of 3 vectors
meet at 10 at the station , platform 9
10 20 30 40 50 60 70 80 90
1.5 2.25 3.125 4.0625 5.03
token = 3fdf5a35c7b8d733c0b5c7d364eda8ac88d929d1
sha1 deadbeef01 commit 9fceb02
section 4.2.1.3 of chapter 7
ratio 16:9 at 60 fps , 1920x1080
he scored 12-4 , 6-3 , 7-5 in 3 sets
at the end of line 7 , a dot appears
%%% 12 *** 34 ### 56 &&& 78 !!
article 25 § 3 no. 1 of 12.12.2012
temperature -12.5 to +30.1 at 1013 hPa
total 1 234 567 inhabitants in 2010
""".strip().splitlines()

# Words that announce or join parts of a span.
CUES = ("at", "(at)", "[at]", "{at}", "dot", "(dot)", "[dot]", "{dot}", ".", "-", "/", "mail", "email", "e-mail", "phone",
        "phone:", "tel", "tel.", "telephone", "call", "fax", "mobile", "ring", "dial", "number", "card", "visa", "number:",
        "ip", "server", "host", "address", "contact", "write", "to", "com", "org", "net", "de", "version", "page", "pages")
_DOTS = ("dot", "(dot)", "[dot]", "{dot}")

_CLASS = np.full(256, 512, np.uint16)
for _chars, _bit in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 4), (b"@", 8),
                     (b".", 16), (b"-_", 32), (b"()[]{}", 64), (b"+", 128), (b":/", 256)):
    _CLASS[list(_chars)] = _bit
_RANK = np.zeros(256, np.int64)
for _bit in range(10):
    _RANK[_CLASS == 1 << _bit] = _bit

_BLOCKS = {"length": 16, "digits": 21, "classes": 1024, "ends": 100, "cue": 64}
_NEAR = ("digits", "classes", "cue")
_TEMPLATES = [("here", name) for name in _BLOCKS] + [(side, name) for side in ("before", "after") for name in _NEAR] + [
    ("before2", "cue"), ("after2", "cue")]
_OFFSETS = np.concatenate([[0], np.cumsum([_BLOCKS[name] + 1 for _, name in _TEMPLATES])])
_STEPS = {"before": -1, "after": 1, "before2": -2, "after2": 2}


def _cue_hashes(words: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    one = words_of([" ".join(words)])
    hashes = one.hashes()
    order = np.argsort(hashes)
    return hashes[order], order


_CUE_KEYS, _CUE_IDS = _cue_hashes(CUES)
_DOT_KEYS, _ = _cue_hashes(_DOTS)


def _lowered(words: Words) -> Words:
    return Words(words.raw.translate(LOWER.tobytes()), words.start, words.end, words.doc, words.first)


def windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words near one that may be part of a span, and the first of them in each window. Windows end with lines."""
    buf = np.frombuffer(words.raw, np.uint8)
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    marks = np.flatnonzero(_DIGITS[buf] | (buf == 64))
    near = np.zeros(n + 1, np.int64)
    hot = np.searchsorted(words.start, marks, "right") - 1
    low, more = words.raw.lower(), []
    if b"dot" in low:
        more = np.flatnonzero(np.isin(_lowered(words).hashes(), _DOT_KEYS)).tolist()
    for mark in (b"(at)", b"[at]", b"{at}"):
        at = low.find(mark)
        while at >= 0:
            more.append(int(np.searchsorted(words.start, at, "right")) - 1)
            at = low.find(mark, at + 1)
    hot = np.union1d(hot, np.array(more, np.int64))
    np.add.at(near, np.maximum(hot - AROUND, 0), 1)
    np.add.at(near, np.minimum(hot + AROUND + 1, n), -1)
    picked = np.flatnonzero(np.cumsum(near[:n]) > 0)
    line = np.searchsorted(np.flatnonzero(buf == 10), words.start[picked])
    new = np.ones(len(picked), bool)
    new[1:] = (np.diff(picked) > 1) | (np.diff(line) > 0)
    return picked, np.append(np.flatnonzero(new), len(picked))


def features(words: Words, picked: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature ids of the picked words; neighbours count only within the window."""
    n = len(picked)
    if not n:
        return np.zeros((0, len(_TEMPLATES)), np.int64)
    start, end = words.start[picked], words.end[picked]
    lengths = end - start
    at = np.repeat(start - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    part = np.frombuffer(words.raw, np.uint8)[at]
    cut = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    text = _lowered(Words(part.tobytes(), bounds[:-1], bounds[1:], cut, cut))
    hashes = text.hashes()
    where = np.minimum(np.searchsorted(_CUE_KEYS, hashes), len(_CUE_KEYS) - 1)
    own = {
        "length": np.minimum(lengths, 15),
        "digits": np.minimum(np.add.reduceat(_DIGITS[part].astype(np.int64), cut), 20),
        "classes": np.bitwise_or.reduceat(_CLASS[part], cut).astype(np.int64),
        "ends": _RANK[part[cut]] * 10 + _RANK[part[bounds[1:] - 1]],
        "cue": np.where(_CUE_KEYS[where] == hashes, _CUE_IDS[where] + 1, 0),
    }
    window = np.repeat(np.arange(len(first) - 1), np.diff(first))
    columns = []
    for k, (side, name) in enumerate(_TEMPLATES):
        values = own[name]
        if side != "here":
            shift = _STEPS[side]
            other = np.clip(np.arange(n) + shift, 0, n - 1)
            inside = (window[other] == window) & (other == np.arange(n) + shift)
            values = np.where(inside, values[other], _BLOCKS[name])
        columns.append(values + _OFFSETS[k])
    return np.stack(columns, axis=1)


def train(examples: list[str] | None = None) -> crf.Chain:
    """The field of a small labelled table: lines with ``<kind>…</kind>`` around spans."""
    texts, marks = [], []
    for line in EXAMPLES if examples is None else examples:
        clean, spans, at = "", [], 0
        for m in re.finditer(r"<(\w+)>(.*?)</\1>", line):
            clean += line[at:m.start()]
            low = len(clean.encode())
            clean += m[2]
            spans.append((low, len(clean.encode()), LABELS.index(m[1])))
            at = m.end()
        texts.append(clean + line[at:])
        marks.append(spans)
    words = words_of(texts)
    picked, first = windows(words)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) + 1 for t in texts])])
    labels = np.zeros(len(picked), np.int64)
    for i, w in enumerate(picked):
        at = words.start[w] - offsets[words.doc[w]]
        labels[i] = next((k for a, b, k in marks[words.doc[w]] if a <= at < b), 0)
    return crf.train(features(words, picked, first), labels, first, int(_OFFSETS[-1]), len(LABELS), rounds=120)


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _octets(parts: list[bytes]) -> bool:
    return all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in parts)


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, in bytes; a match never crosses a line end."""
    found, end, at = [], 0, raw.find(b"@")
    while at >= 0:
        low = at
        while low > end and _LOCAL[raw[low - 1]]:
            low -= 1
        if low < at and (m := _DOMAIN.match(raw, at + 1)):
            end = m.end()
            found.append(("email", low, end))
        at = raw.find(b"@", max(at + 1, end))
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(raw) if _octets(m[0].split(b"."))]
    for m in _CARD.finditer(raw):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(b" ", b"").replace(b"-", b"")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(raw):
        if 9 <= sum(48 <= c < 58 for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def possible(kind: str, part: str) -> bool:
    """Whether a labelled run can be what its label says; in time linear in its length.

    In an email a local part holds no ``at`` and a word of the domain no ``dot`` as a word of its own: that is a separator."""
    part = re.sub(r"\s+", " ", part)
    digits = re.sub(r"\D", "", part)
    if kind == "email":
        return bool(re.fullmatch(
            r"(?:(?!\bat\b)[\w.%+-])++\s?(?:@|[\[({]\s?at\s?[\])}]|\bat\b)\s?(?:(?!\bdot\b)[\w-])++"
            r"(?:\s?(?:\.|[\[({]\s?dot\s?[\])}]|\bdot\b)\s?(?:(?!\bdot\b)[\w-])++)++", part, re.I))
    if kind == "ip":
        four = re.split(r"\s*(?:[\[({]?(?:\.|dot)[\])}]?|-)\s*", part)
        six = re.fullmatch(r"(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}", part)
        return bool(six) or len(four) == 4 and all(p.isascii() and p.isdigit() for p in four) and _octets([p.encode() for p in four])
    if not digits.isascii() or re.search(r"[^\W\d_]", part):
        return False
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits.encode())
    return 7 <= len(digits) <= 15 and re.search(r"[^0-9]", part) is not None


def find(texts: list[str], chain: crf.Chain) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text, in order."""
    words = words_of(texts)
    raw = words.raw
    bounds = np.concatenate([[0], np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])])
    base = base_spans(raw)
    picked, first = windows(words)
    labels = chain.decode(features(words, picked, first), first)
    taken = np.zeros(len(raw) + 1, np.int64)
    for _, a, b in base:
        taken[a] += 1
        taken[b] -= 1
    taken = np.concatenate([[0], np.cumsum(np.cumsum(taken) > 0)])
    window = np.repeat(np.arange(len(first) - 1), np.diff(first))
    edge = np.ones(len(labels), bool)
    edge[1:] = (labels[1:] != labels[:-1]) | (window[1:] != window[:-1])
    heads = np.flatnonzero(edge)
    tails = np.append(heads, len(labels))[1:]
    found = [(kind, a, b, True) for kind, a, b in base]
    for a, b in zip(heads, tails, strict=True):
        if labels[a]:
            low, high = int(words.start[picked[a]]), int(words.end[picked[b - 1]])
            part = raw[low:high].decode("utf-8", "surrogatepass")
            core = part.lstrip(" ,;:!?*#$%&|<>\"'.-/=")
            low += len(part.encode("utf-8", "surrogatepass")) - len(core.encode("utf-8", "surrogatepass"))
            core = core.rstrip(" ,;:!?*#$%&|<>\"'.-/=+")
            high = low + len(core.encode("utf-8", "surrogatepass"))
            if core and taken[high] == taken[low] and possible(LABELS[labels[a]], core):
                found.append((LABELS[labels[a]], low, high, False))
    spans: list[list] = [[] for _ in texts]
    if found:
        points = code_points(raw)
        for kind, a, b, own in found:
            i = int(np.searchsorted(bounds, a, "right")) - 1
            spans[i].append((kind, int(points[a] - points[bounds[i]]), int(points[b] - points[bounds[i]]), own))
    return [in_order(s, KINDS) for s in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: list[str] | None = None) -> DataFrame:
    """``id`` and ``spans`` (array of kind, start, end, base) of every document."""
    chain = train(examples)

    def start():
        def function(texts):
            return ([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in found] for found in find(texts, chain)],)

        return function

    return per_document(docs, id_col, text_col, [T.StructField("spans", T.ArrayType(SPAN))], start)
