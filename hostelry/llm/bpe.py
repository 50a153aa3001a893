"""Byte-level BPE: texts to token ids and back.

Each match of the split pattern is merged on its own. A segment tree over the byte positions of a match
holds, in the leaf of every live token, the rank of the pair it forms with its live right neighbour; the
root is the lowest rank, leftmost first. A merge changes three leaves (the token, the one it swallowed and
the left neighbour) and the paths above them, so a match of n bytes costs O(n log n) however long it is.
Short matches are merged many at a time, one tree per row of an array.

Matches found before are remembered in each Python worker, up to ``MEMO`` bytes of them.

Cases: null and empty texts give no tokens; repeated rows give repeated results; ids may be null or repeat;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostelry.llm.frames import per_document

#: Bytes of remembered matches, about, and the longest match (in bytes) that is merged in a batch.
MEMO = 24_000_000
#: What an entry takes besides its characters and ids.
ENTRY = 180
SHORT = 64
_NONE = np.int64(1) << np.int64(62)
_BITS = 24


class Codec:
    """Ranks and split pattern of one vocabulary."""

    def __init__(self, ranks: bytes, pattern: str):
        rows = (line.split() for line in ranks.splitlines() if line)
        self.ids = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens = [b""] * (max(self.ids.values(), default=-1) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {
            (self.ids[token[:k]], self.ids[token[k:]]): i for token, i in self.ids.items()
            for k in range(1, len(token)) if token[:k] in self.ids and token[k:] in self.ids}
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], _NONE)
        self.ranks = np.append(np.array(list(self.pairs.values()), np.int64)[order], -1)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}
        self.held = 0

    # one long match

    def merge_long(self, piece: bytes) -> list[int]:
        """Segment tree in a list; for matches too long to pad."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        none, pairs = 1 << 62, self.pairs
        token = [int(x) for x in self.byte_ids[list(piece)]]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)

        def key(i):
            j = right[i]
            rank = pairs.get((token[i], token[j])) if j < n else None
            return none if rank is None else rank << 40 | i

        for i in range(n):
            tree[size + i] = key(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i, value):
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                low = tree[2 * i] if tree[2 * i] < tree[2 * i + 1] else tree[2 * i + 1]
                if tree[i] == low:
                    return
                tree[i] = low

        while tree[1] != none:
            rank, i = tree[1] >> 40, tree[1] & (1 << 40) - 1
            j = right[i]
            token[i], right[i] = rank, right[j]
            if right[j] < n:
                left[right[j]] = i
            put(j, none)
            put(i, key(i))
            if left[i] >= 0:
                put(left[i], key(left[i]))
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = right[i]
        return out

    # many short matches

    def _pair(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf value of the pair (a, b) at a position; b is negative where nothing follows."""
        wanted = a << 32 | np.maximum(b, 0)
        where = np.searchsorted(self.keys, wanted)
        known = (self.keys[where] == wanted) & (b >= 0) & (a >= 0)
        return np.where(known, self.ranks[where] << _BITS | at, _NONE)

    def merge_short(self, pieces: list[bytes]) -> list[bytes]:
        """One segment tree per row; every row makes one merge per step until none has one left."""
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        size = 1 << int(lengths.max() - 1).bit_length()
        grid = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        inside = np.arange(size) < lengths[:, None]
        token = np.where(inside, self.byte_ids[grid], -1)
        token = np.concatenate([token, np.full((n, 1), -1)], axis=1)  # column ``size``: nothing there
        right = np.tile(np.arange(1, size + 1), (n, 1))
        right = np.where(np.arange(size) == lengths[:, None] - 1, size, right)
        left = np.tile(np.arange(-1, size), (n, 1))
        tree = np.full((n, 2 * size), _NONE)
        spot = np.tile(np.arange(size), (n, 1))
        tree[:, size:] = self._pair(token[:, :size], np.take_along_axis(token, right, 1), spot)
        level = size
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] != _NONE)
        while len(live):
            root = tree[live, 1]
            i = root & ((1 << _BITS) - 1)
            j = right[live, i]
            k = right[live, j]
            token[live, i] = root >> _BITS
            token[live, j] = -1
            right[live, i] = k
            left[live, k] = i
            before = left[live, i]
            there = before >= 0
            h = np.where(there, before, i)
            tree[live, size + j] = _NONE
            own = self._pair(token[live, i], token[live, k], i)
            tree[live, size + i] = own
            tree[live, size + h] = np.where(there, self._pair(token[live, h], token[live, i], h), own)
            rows = np.concatenate([live, live, live])
            up = np.concatenate([i, j, h]) + size
            while size > 1 and up[0] > 1:
                up >>= 1
                tree[rows, up] = np.minimum(tree[rows, 2 * up], tree[rows, 2 * up + 1])
            live = live[tree[live, 1] != _NONE]
        kept = token[:, :size] >= 0
        ids = token[:, :size][kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Adds the packed ids of new matches to the memo."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            i = self.ids.get(raw)
            if i is not None:
                self.memo[piece] = i.to_bytes(4, "little")
            elif len(raw) > SHORT:
                self.memo[piece] = np.array(self.merge_long(raw), "<u4").tobytes()
            else:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for group in groups.values():
            for a in range(0, len(group), 4096):
                part = group[a:a + 4096]
                self.memo.update(zip((p for p, _ in part), self.merge_short([raw for _, raw in part]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text: little-endian unsigned 32-bit integers."""
        matches = [self.split(t) for t in texts]
        new = set(filterfalse(self.memo.__contains__, chain.from_iterable(matches)))
        size = sum(map(len, new)) * 2 + ENTRY * len(new)
        if self.held + size > MEMO:
            self.forget()
            new = set().union(*matches)
            size = sum(map(len, new)) * 2 + ENTRY * len(new)
        self.held += size
        self.learn(new)
        return [b"".join(map(self.memo.__getitem__, found)) for found in matches]

    def forget(self) -> None:
        self.memo.clear()
        self.held = 0

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec(blob: bytes, pattern: str) -> Codec:
    """The codec of a compressed rank file, made once in each Python worker."""
    name = hashlib.sha256(blob + pattern.encode()).hexdigest()
    if name not in _codecs:
        _codecs[name] = Codec(zlib.decompress(blob), pattern)
    return _codecs[name]


def load(path: str) -> bytes:
    """Rank file (base64 token and rank per line), compressed for shipping. A vocabulary has a fixed size
    that does not follow the corpus, so tasks get it with their code."""
    with open(path, "rb") as f:
        return zlib.compress(f.read())


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_tokens`` and ``ids``: packed little-endian unsigned 32-bit integers. Special tokens are plain text."""
    blob = load(ranks)

    def start():
        own = codec(blob, pattern)

        def function(texts):
            ids = own.encode(texts)
            return [len(x) // 4 for x in ids], pa.array(ids, pa.binary())

        return function

    return per_document(docs, id_col, text_col, [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())], start)


def decode(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the bytes that the packed ids stand for (null ids: null). A column of that name is replaced."""
    blob = load(ranks)
    rest = encoded.drop("decoded")
    schema = T.StructType([*rest.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        own = codec(blob, pattern)
        for batch in batches:
            out = [None if x is None else own.decode(x) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return rest.mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one Python stage: id, ``n_tokens``, ``ids``, ``decoded``."""
    blob = load(ranks)

    def start():
        own = codec(blob, pattern)

        def function(texts):
            ids = own.encode(texts)
            return [len(x) // 4 for x in ids], pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())

        return function

    return per_document(docs, id_col, text_col, [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.BinaryType())], start)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return decoded.select(
        id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
