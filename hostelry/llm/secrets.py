"""Secrets in texts, also inside nested encodings.

Base spans come from three patterns on the text itself. Then a worklist unwraps the text layer by layer:
every URL-encoded, Unicode-escaped, base64 or compressed run of a layer is replaced by what it stands for,
and the new layer is scanned and unwrapped again, until nothing changes (fixpoint) or a layer returns that
was seen before (cycle). Each layer keeps, for every piece, the place in the text that it came from, so what
is found in it maps back; a find inside a decoded run covers the whole run.

Base64 may be wrapped at any column. A decoded run that is not text stays where it is, and its bytes are scanned by
themselves, with what is encoded in them. A run that unpacks to more than ``max_layer`` bytes is read as a stream, in
pieces of that size that overlap, so it is scanned whole in bounded memory; its finds cover the run like any other.

An escape that stands for the beginning of another escape (``%2525...``, ``&#38;#37;...``) is followed to the end in one
step, so a layer never peels one sign of a long chain. What else nests (base64, escapes written in escapes) shrinks by
a share with every layer, and the time stays near linear in the text and what it unpacks to.

Cases: null and empty texts have no spans; repeated rows give repeated results; an empty table gives an empty
table; other columns are not read; very long texts are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostelry.llm.frames import chunks, per_document
from hostelry.llm.spans import SPAN, blanked, code_points, digests, in_order  # noqa: F401

KINDS = ("assign", "access", "hex")
#: Largest decompressed run that becomes a layer, in bytes, and what pieces of a larger one share.
MAX_LAYER, OVERLAP = 8_000_000, 4096

_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_ASSIGN = re.compile(
    rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
_PERCENT_RUN = re.compile(r"(?:[^\s%]|%(?![0-9A-Fa-f]{2}))*+(?:%[0-9A-Fa-f]{2}[^\s%]*+(?:%(?![0-9A-Fa-f]{2})[^\s%]*+)*+)++")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
#: Lines of 16 signs or more, and the rest in the last one.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+[\x20\t]{0,8}\r?\n[\x20\t]{0,8})++[A-Za-z0-9+/_-]++={0,2}")
#: Escapes that stand for the first sign of an escape.
_CHAIN = re.compile(
    r"%(?:2[56]|5[Cc])|\\x(?:2[56]|5[Cc])|\\u00(?:2[56]|5[Cc])|\\u\{0{0,4}(?:2[56]|5[Cc])\}|&#x0{0,4}(?:2[56]|5[Cc]);|&#0{0,4}(?:3[78]|92);")
_LONGEST = 12


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_HEX = _table(b"0123456789abcdef")
_ANY_HEX = _table(b"0123456789abcdefABCDEF")
_B64 = _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def long_runs(buf: np.ndarray, kind: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes of a kind, of ``least`` bytes or more."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = kind[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    keep = end - start >= least
    return list(zip(start[keep].tolist(), end[keep].tolist(), strict=True))


def base_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """Spans of the three patterns, in bytes; a match never crosses a line end."""
    found = [("hex", a, b) for a, b in long_runs(np.frombuffer(raw, np.uint8), _HEX, 24)]
    at = raw.find(b"AKIA")
    while at >= 0:
        end = m.end() if (m := _ACCESS.match(raw, at)) else at + 4
        if end - at >= 20:
            found.append(("access", at, end))
        at = raw.find(b"AKIA", end)
    low, starts = raw.lower(), []
    for word in _WORDS:
        at = low.find(word)
        while at >= 0:
            starts.append(at)
            at = low.find(word, at + 1)
    end = 0
    for at in sorted(starts):
        if at >= end and (m := _ASSIGN.match(raw, at)):
            end = m.end()
            if len(m[1]) >= 6:
                found.append(("assign", at, end))
    return found


def may_hide(raw: bytes) -> list[int]:
    """Places where an encoded run may lie; none means that there is no further layer."""
    buf = np.frombuffer(raw + b"\0\0", np.uint8)
    percent = np.flatnonzero(buf[:-2] == 37)
    percent = percent[_ANY_HEX[buf[percent + 1]] & _ANY_HEX[buf[percent + 2]]]
    places = percent.tolist() + [a for a, _ in long_runs(buf, _B64, 16)]
    for mark in (b"\\u", b"\\x", b"&#"):
        at = raw.find(mark)
        while at >= 0:
            places.append(at)
            at = raw.find(mark, at + 1)
    return places


def _readable(raw: bytes) -> str | None:
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    plain = sum(c.isprintable() or c in "\t\n\r" for c in text)
    return text if text and plain >= 0.9 * len(text) else None


def _packed(raw: bytes) -> bool:
    return raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 1 and int.from_bytes(raw[:2], "big") % 31 == 0)


def _inflated(raw: bytes, size: int) -> Iterator[bytes]:
    """Unpacked zlib or gzip data, all members, as far as they go if they are cut off, in pieces of at most ``size`` bytes."""
    at = 0
    try:
        while _packed(raw[at:at + 2]):
            unpack = zlib.decompressobj(wbits=47)
            while at < len(raw) and not unpack.eof:
                part = raw[at:at + 4096]
                out = unpack.decompress(part, size)
                while out:
                    yield out
                    out = unpack.decompress(unpack.unconsumed_tail, size)
                at += len(part) - len(unpack.unused_data)
    except zlib.error:
        pass  # what came before the broken part counts


#: Digests of the bytes being read, so that bytes that hold themselves end.
_reading: set[bytes] = set()


def _kinds_in(raw: bytes, limit: int) -> set[str]:
    """Kinds of secrets in bytes that are no text, or too many to be a layer, and in what they hold."""
    mark = hashlib.sha256(raw).digest()
    if mark in _reading:
        return set()
    _reading.add(mark)
    try:
        return _kinds_within(raw, limit)
    finally:
        _reading.discard(mark)


def _kinds_within(raw: bytes, limit: int) -> set[str]:
    found: set[str] = set()
    if _packed(raw):
        tail, held, some = b"", [], False
        for piece in _inflated(raw, limit):
            some = True
            held.append(piece)
            if sum(map(len, held)) >= limit:
                whole = tail + b"".join(held)
                found |= _kinds_in(whole, limit)
                tail, held = whole[-OVERLAP:], []
        if held:
            found |= _kinds_in(tail + b"".join(held), limit)
        if some:
            return found
    found |= {kind for kind, _, _ in base_spans(raw)}
    if may_hide(raw):
        found |= {kind for kind, _, _ in hidden_spans(raw.decode("utf-8", "replace"), limit)}
    return found


def _meaning(raw: bytes, limit: int) -> str | set[str] | None:
    """What decoded bytes, compressed any number of times or not at all, stand for: a text, or else the kinds found in them."""
    start, seen = raw, set()
    while _packed(raw):
        mark = hashlib.sha256(raw).digest()
        if mark in seen:
            return None
        seen.add(mark)
        pieces, size = [], 0
        for piece in _inflated(raw, limit):
            pieces.append(piece)
            size += len(piece)
            if size > limit:
                return _kinds_in(start, limit) or None
        if not size:
            break
        raw = b"".join(pieces)
    text = _readable(raw)
    return _kinds_in(raw, limit) or None if text is None else text


def _from_base64(run: str, limit: int) -> str | set[str] | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return _meaning(base64.b64decode(body + "=" * (-len(body) % 4), validate=True), limit)
    except binascii.Error:
        return None


def _escaped(m: re.Match) -> str:
    code = m[0]
    n = int(code[2:-1]) if code[:2] == "&#" and code[2] != "x" else int(re.sub(r"[^0-9A-Fa-f]", "", code[2:]), 16)
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else code


_BYTE = re.compile(r"%[0-9A-Fa-f]{2}")


def _chains(text: str) -> list[tuple[int, int, str]]:
    """Escapes that stand for the beginning of another one, with it, and so on: (start, end, the last escape of the chain)."""
    out, end = [], 0
    for m in _CHAIN.finditer(text):
        if m.start() < end:
            continue
        last, at, links = m[0], m.end(), 0
        while True:
            sign = chr(int(last[1:], 16)) if last[0] == "%" else _escaped(_ESCAPE.match(last))
            ahead = sign + text[at:at + _LONGEST]
            follows = (_BYTE if sign == "%" else _ESCAPE).match(ahead) if sign in "%&\\" else None
            if follows is None:
                break
            last, at, links = follows[0], at + len(follows[0]) - 1, links + 1
        if links:
            out.append((m.start(), at, last))
            end = at
    return out


def decoded_runs(text: str, limit: int) -> list[tuple[int, int, str | set[str]]]:
    """Encoded runs of one layer that stand for something else, without overlaps: (start, end, meaning); chains of escapes first."""
    if chains := _chains(text):
        return chains
    found: list[tuple[int, int, str | set[str]]] = []
    if "%" in text:
        for m in _PERCENT_RUN.finditer(text):
            raw = unquote_to_bytes(m[0])
            out = raw.decode("utf-8", "replace")
            if "\ufffd" in out and _packed(raw):
                out = _meaning(raw, limit) or out  # the bytes were a compressed stream
            if out != m[0]:
                found.append((m.start(), m.end(), out))
    found += [(m.start(), m.end(), out) for m in _ESCAPE.finditer(text) if (out := _escaped(m)) != m[0]]
    found += [(m.start(), m.end(), out) for m in _BASE64.finditer(text) if (out := _from_base64(m[0], limit)) is not None]
    found += [(m.start(), m.end(), out) for m in _WRAPPED.finditer(text) if (out := _from_base64("".join(m[0].split()), limit)) is not None]
    found.sort(key=lambda x: (x[0], -x[1]))
    out, end = [], 0
    for run in found:
        if run[0] >= end:
            out.append(run)
            end = run[1]
    return out


def hidden_spans(text: str, limit: int = MAX_LAYER) -> set[tuple[str, int, int]]:
    """Spans that only an inner layer shows, in code points of ``text``."""
    found: set[tuple[str, int, int]] = set()
    # a piece: its text, where it came from, and whether it was decoded
    pieces: list[tuple[str, int, int, bool]] = [(text, 0, len(text), False)]
    layer, seen = text, set()
    while True:
        mark = hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest()
        if mark in seen:
            return found
        seen.add(mark)
        runs = decoded_runs(layer, limit)
        if not runs:
            return found
        starts = np.cumsum([0] + [len(p[0]) for p in pieces])

        def place(a, b, pieces=pieces, starts=starts):
            """Origin of a part of the layer: start, end, and whether any of it was decoded."""
            i = int(np.searchsorted(starts, a, "right")) - 1
            j = int(np.searchsorted(starts, b, "left")) - 1
            first, last = pieces[i], pieces[j]
            low = first[1] if first[3] else first[1] + a - int(starts[i])
            high = last[2] if last[3] else last[1] + b - int(starts[j])
            return low, high, any(p[3] for p in pieces[i:j + 1])

        new, at = [], 0

        def keep(a, b, pieces=pieces, starts=starts):
            """Pieces of the unchanged part a … b of the layer."""
            i = int(np.searchsorted(starts, a, "right")) - 1
            while a < b:
                piece, end = pieces[i], min(b, int(starts[i + 1]))
                part = piece[0][a - int(starts[i]):end - int(starts[i])]
                low = piece[1] if piece[3] else piece[1] + a - int(starts[i])
                new.append((part, low, piece[2] if piece[3] else low + len(part), piece[3]))
                a, i = end, i + 1

        for a, b, meaning in runs:
            low, high, _ = place(a, b)
            if isinstance(meaning, set):  # not a text: the run stays
                found |= {(kind, low, high) for kind in meaning}
                continue
            keep(at, a)
            new.append((meaning, low, high, True))
            at = b
        keep(at, len(layer))
        pieces = [p for p in new if p[0]]
        layer = "".join(p[0] for p in pieces)
        raw = layer.encode("utf-8", "surrogatepass")
        points = code_points(raw)
        starts = np.cumsum([0] + [len(p[0]) for p in pieces])
        for kind, a, b in base_spans(raw):
            low, high, inner = place(int(points[a]), int(points[b]), pieces, starts)
            if inner:
                found.add((kind, low, high))


def scan_texts(texts: list[str], limit: int = MAX_LAYER) -> list[list[tuple[str, int, int, bool]]]:
    """All spans of each text, in order."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join(parts) + b"\n"
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    spans: list[list] = [[] for _ in texts]
    if base := base_spans(raw):
        points = code_points(raw)
        for kind, a, b in base:
            i = int(np.searchsorted(bounds, a, "right")) - 1
            spans[i].append((kind, int(points[a] - points[bounds[i]]), int(points[b] - points[bounds[i]]), True))
    for i in sorted(set((np.searchsorted(bounds, may_hide(raw), "right") - 1).tolist())):
        known = {s[:3] for s in spans[i]}
        spans[i] += [(*s, False) for s in hidden_spans(texts[i], limit) if s not in known]
    return [in_order(s, KINDS) for s in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """``id`` and ``spans`` (array of kind, start, end, base) of every document."""

    def start():
        def function(texts):
            return ([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in found]
                     for found in scan_texts(texts, max_layer)],)

        return function

    return per_document(docs, id_col, text_col, [T.StructField("spans", T.ArrayType(SPAN))], start)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", max_layer: int = MAX_LAYER) -> DataFrame:
    """The table with every span of a text replaced by ``mask``; null texts stay null, columns and rows stay."""

    @F.pandas_udf("string")
    def clean(column):
        texts, out = [t or "" for t in column], []
        for a, b in chunks(texts):
            out += [blanked(t, s, mask) if s else t for t, s in zip(texts[a:b], scan_texts(texts[a:b], max_layer), strict=True)]
        return type(column)([None if t is None else new for t, new in zip(column, out, strict=True)])

    return docs.withColumn(text_col, clean(F.col(text_col)))
