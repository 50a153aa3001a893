"""Words of many texts at once, as numpy arrays over one UTF-8 buffer.

A word is a maximal run of bytes other than the six ASCII blanks (space, tab to carriage return).
Hashes are 64-bit and depend on the bytes of the word only, so they agree between tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: Powers that a worker keeps; those of a longer buffer are made for it alone.
KEPT_POWERS = 1 << 20


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0 … n-1 of the hash step or of its inverse."""
    have = _powers[kind]
    if len(have) < n:
        have = np.full(max(n, min(2 * len(have), KEPT_POWERS)), _STEP if kind == "up" else _INVERSE, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= KEPT_POWERS:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over the whole value."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@dataclass
class Words:
    raw: bytes
    start: np.ndarray  # first byte of each word in ``raw``
    end: np.ndarray  # byte after its last
    doc: np.ndarray  # text it is in
    first: np.ndarray  # per text, its first word; one entry more at the end

    @cached_property
    def _sums(self) -> np.ndarray:
        buf = np.frombuffer(self.raw, np.uint8)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[buf] * _power("up", len(buf)), out=sums[1:])
        return sums

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """Hash of every word, or of its first ``prefix`` bytes (of all of it, if it is shorter)."""
        end = self.end if prefix is None else np.minimum(self.end, self.start + prefix)
        return mix((self._sums[end] - self._sums[self.start]) * _power("down", len(self.raw) + 1)[self.start])

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i]:self.end[i]]


def words_of(texts: list[str], lower: bool = False, blank: np.ndarray = BLANK) -> Words:
    """``lower`` turns A-Z to a-z, nothing else. ``blank`` says which bytes are in no word; the line end must be one."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\n".join(parts) + b"\n"
    if lower:
        raw = raw.translate(LOWER.tobytes())
    blank = blank[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(parts)), np.diff(first))
    return Words(raw, start, end, doc, first)


def shingles(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``n`` words that lies in one text, and the window's first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc *= _STEP
        acc += hashes[k:k + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1:])
    return mix(acc[at]), at
