"""Removal of word sequences that an earlier document has.

A window is ``width`` consecutive words of one document. Every word covered by a window whose words also start in
a document with a smaller id is removed.

Documents are dealt to chunks by the hash of their id; a chunk is what one call of a task holds. Inside a chunk
repeats are found exactly. Between chunks:

1. each chunk makes a sketch of its distinct windows: per hash row the cells they fall in. The sketches are cut
   into blocks of cells and merged by block; a window's count of chunks is at most the lowest count of its cells
   (count-min), so cells that only one chunk has rule a window out and no repeated window is ever lost;
2. only windows estimated in two chunks or more are grouped exactly (two independent 64-bit hashes of the
   words), one entry per window and chunk, and the chunks learn which of theirs start earlier elsewhere.

The texts are shuffled once; the three passes read the same shuffle. A very common window costs one entry per
chunk, not one per document. The widths of sketch, blocks and chunks follow the size of the input, which one
aggregate measures first (the only job that runs while the plan is built).

Cases: null and empty texts have no words; rows with equal ids never remove from each other; a null id counts as
larger than any other; texts shorter than a window stay whole; an empty table gives an empty table; other columns
are not read; ids are integers.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostelry.llm.words import Words, mix, shingles, words_of

WIDTH = 13
#: Characters of text in a chunk and behind a block of the sketch, on average.
CHUNK_CHARS, BLOCK_CHARS = 4_000_000, 16_000_000
#: Hash rows of the sketch, cells per window in each, and characters of a word with its blank, about.
DEPTH, CELLS, WORD_CHARS = 2, 8, 6
_LAST = np.iinfo(np.int64).max
_SALTS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _Chunk:
    """Documents of a chunk in the order of their ids, their words and their windows."""

    def __init__(self, rows: pa.Table, width: int):
        self.width = width
        ids = rows.column("id_").fill_null(_LAST).to_numpy()
        texts = rows.column("text_").to_pylist()
        self.order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.ids = ids[self.order]
        self.words: Words = words_of([texts[i] for i in self.order])
        own = self.words.hashes()
        self.own = own
        self.one, self.at = shingles(own, self.words.doc, width)

    @cached_property
    def two(self) -> np.ndarray:
        return shingles(mix(self.own ^ np.uint64(_SALTS[3])), self.words.doc, self.width)[0]

    def cells(self, row: int, cells: int) -> np.ndarray:
        """Cell of each window in a hash row."""
        return mix(self.one ^ np.uint64(_SALTS[row])) % np.uint64(cells)

    def groups(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some windows: the order that brings equal ones together, where each group of equal ones begins in it,
        and the first window of each group, which is in its earliest document."""
        order = windows[np.argsort(self.one[windows])]
        one, two = self.one[order], self.two[order]
        if ((one[1:] == one[:-1]) & (two[1:] != two[:-1])).any():
            order = windows[np.lexsort((self.two[windows], self.one[windows]))]
            one, two = self.one[order], self.two[order]
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        starts = np.flatnonzero(new)
        return order, starts, np.minimum.reduceat(order, starts) if len(starts) else starts


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _pack(cells: np.ndarray) -> bytes:
    """Sorted distinct integers as Rice-coded gaps: a few bits more than the logarithm of the mean gap for each."""
    if not len(cells):
        return b""
    gaps = np.concatenate([cells[:1], np.diff(cells) - np.uint64(1)])
    k = int(np.log2(float(cells[-1]) / len(cells) + 1))
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ones = np.cumsum(high + 1)
    unary = np.zeros(int(ones[-1]), np.uint8)
    unary[ones - 1] = 1
    parts = [np.array([len(cells), len(unary), k], "<u8").tobytes(), np.packbits(unary).tobytes()]
    parts += [((gaps >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8).tobytes() for i in range(k // 8)]
    for i in range(k // 8 * 8, k):
        parts.append(np.packbits(((gaps >> np.uint64(i)) & np.uint64(1)).astype(np.uint8)).tobytes())
    return b"".join(parts)


def _unpack(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    n, length, k = (int(x) for x in np.frombuffer(packed, "<u8", 3))
    at = 24 + -(-length // 8)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, at - 24, 24), count=length))
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    for i in range(k // 8):
        gaps |= np.frombuffer(packed, np.uint8, n, at).astype(np.uint64) << np.uint64(8 * i)
        at += n
    for i in range(k // 8 * 8, k):
        size = -(-n // 8)
        gaps |= np.unpackbits(np.frombuffer(packed, np.uint8, size, at), count=n).astype(np.uint64) << np.uint64(i)
        at += size
    return np.cumsum(gaps + np.uint64(1), dtype=np.uint64) - np.uint64(1)


def _narrow(values: np.ndarray) -> bytes:
    """Integers in as few bytes as the largest needs; the first byte is their size."""
    size = next(b for b in (1, 2, 4, 8) if b == 8 or not len(values) or -(1 << 8 * b - 1) <= values.min() and values.max() < 1 << 8 * b - 1)
    return bytes([size]) + values.astype(f"<i{size}").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[0]}", offset=1).astype(np.int64)


def _table(schema: pa.Schema, columns: list[list]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _by_block(cells: np.ndarray, span: int) -> list[tuple[int, np.ndarray]]:
    """Sorted cells cut into blocks of ``span`` cells: (block, cells counted from its begin)."""
    block = cells // np.uint64(span)
    cuts = np.flatnonzero(np.diff(block)) + 1
    starts = np.concatenate([[0], cuts, [len(cells)]]).astype(np.int64)
    return [(int(block[a]), cells[a:b] - block[a] * np.uint64(span)) for a, b in zip(starts[:-1], starts[1:], strict=True) if b > a]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, depth: int = DEPTH, cells_per_window: int = CELLS,
    chunk_chars: int = CHUNK_CHARS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``id, n_words, n_removed, kept``: the kept words of every document, joined by one space."""
    slim = docs.select(F.col(id_col).cast("long").alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    chars = slim.agg(F.coalesce(F.sum(F.length("text_")), F.lit(0))).first()[0]
    n_chunks, n_blocks = (int(chars // c) + 1 for c in (chunk_chars, block_chars))
    cells = max(1024, int(chars) // WORD_CHARS * cells_per_window)
    span = -(-cells // n_blocks)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.withColumn("chunk_", F.pmod(F.xxhash64("id_"), F.lit(n_chunks)).cast("int")).repartition(parts, "chunk_")

    sketch_schema = pa.schema([("block_", pa.int64()), ("chunk_", pa.int32()), ("cells_", pa.binary())])

    def sketch(key, rows):
        chunk = _Chunk(rows, width)
        out = [[], [], []]
        for row in range(depth):
            for block, part in _by_block(_distinct(chunk.cells(row, cells)), span):
                for column, value in zip(out, (row * n_blocks + block, key[0].as_py(), _pack(part)), strict=True):
                    column.append(value)
        return _table(sketch_schema, out)

    bits_schema = pa.schema([("chunk_", pa.int32()), ("block_", pa.int64()), ("bits_", pa.binary())])

    def merge(key, rows):
        """Which of its cells another chunk has too: per chunk one bit per cell, in order."""
        sets = [_unpack(x) for x in rows.column("cells_").to_pylist()]
        whole = np.sort(np.concatenate(sets))
        many = _distinct(whole[1:][whole[1:] == whole[:-1]])
        bits = []
        for own in sets:
            where = np.searchsorted(many, own)
            where[where == len(many)] = 0
            bits.append(np.packbits(many[where] == own).tobytes() if len(many) else bytes(-(-len(own) // 8)))
        return _table(bits_schema, [rows.column("chunk_").to_pylist(), [key[0].as_py()] * len(sets), bits])

    entry_schema = pa.schema([("bucket_", pa.int64()), ("chunk_", pa.int32()), ("keys_", pa.binary()), ("ids_", pa.binary()), ("at_", pa.binary())])

    def candidates(key, rows, bits):
        """One entry per distinct window that may be in another chunk: its hashes, the first document with it, its place."""
        chunk = _Chunk(rows, width)
        answer = dict(zip(bits.column("block_").to_pylist(), bits.column("bits_").to_pylist(), strict=True))
        maybe = np.ones(len(chunk.one), bool)
        for row in range(depth):
            own = chunk.cells(row, cells)
            order = np.argsort(own)
            ordered = own[order]
            new = np.ones(len(own), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            flags = [np.unpackbits(np.frombuffer(answer[row * n_blocks + block], np.uint8), count=len(part))
                     for block, part in _by_block(ordered[new], span)]
            if len(own):
                maybe[order] &= np.concatenate(flags).astype(bool)[np.cumsum(new) - 1]
        _, _, first = chunk.groups(np.flatnonzero(maybe))
        bucket = chunk.one[first] % np.uint64(n_blocks)
        out = [[], [], [], [], []]
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[by])) + 1
        for group in np.split(first[by], cuts) if len(first) else []:
            keys = np.stack([chunk.one[group], chunk.two[group]], axis=1)
            ids = chunk.ids[chunk.words.doc[chunk.at[group]]]
            values = (int(chunk.one[group[0]] % np.uint64(n_blocks)), key[0].as_py(), keys.tobytes(), _narrow(ids), group.astype("<u4").tobytes())
            for column, value in zip(out, values, strict=True):
                column.append(value)
        return _table(entry_schema, out)

    late_schema = pa.schema([("chunk_", pa.int32()), ("late_", pa.binary())])

    def group(rows):
        """Places of the windows of which another chunk has an earlier document."""
        keys = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in rows.column("keys_").to_pylist()]
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        ids = np.concatenate([_wide(x) for x in rows.column("ids_").to_pylist()])
        at = np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("at_").to_pylist()])
        keys = np.concatenate(keys)
        order = np.lexsort((ids, keys[:, 1], keys[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
        first = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        late = np.sort(order[ids[order] > first])
        found = defaultdict(bytes)
        cuts = np.flatnonzero(np.diff(owner[late])) + 1
        for part in np.split(late, cuts) if len(late) else []:
            found[int(owner[part[0]])] = at[part].astype("<u4").tobytes()
        chunks = rows.column("chunk_").to_pylist()
        return _table(late_schema, [[chunks[i] for i in found], list(found.values())])

    final_schema = pa.schema([("id_", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(rows, late):
        chunk = _Chunk(rows, width)
        words = chunk.words
        doc = words.doc[chunk.at] if len(chunk.at) else np.zeros(0, np.int64)
        order, starts, first = chunk.groups(np.arange(len(chunk.one)))
        gone = np.zeros(len(chunk.one), bool)
        if len(order):
            group_of = np.zeros(len(order), np.int64)
            group_of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
            gone = chunk.ids[doc] > chunk.ids[doc[first]][group_of]
            elsewhere = np.zeros(len(starts), bool)
            for part in late.column("late_").to_pylist():
                elsewhere[group_of[np.frombuffer(part, "<u4")]] = True
            gone |= elsewhere[group_of]
        cover = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(cover, chunk.at[gone], 1)
        np.add.at(cover, chunk.at[gone] + width, -1)
        keep = np.cumsum(cover[:-1]) == 0
        # runs of kept words of one document: from word, to word
        edge = np.ones(len(keep), bool)
        edge[1:] = (keep[1:] != keep[:-1]) | (words.doc[1:] != words.doc[:-1])
        heads = np.flatnonzero(edge)
        tails = np.append(heads, len(keep))[1:]
        pieces = [[] for _ in chunk.ids]
        for a, b, d in zip(words.start[heads[keep[heads]]].tolist(), words.end[tails[keep[heads]] - 1].tolist(),
                           words.doc[heads[keep[heads]]].tolist(), strict=True):
            pieces[d] += words.raw[a:b].split()
        kept = [b" ".join(p).decode("utf-8", "surrogatepass") for p in pieces]
        n_words = np.diff(words.first)
        total = np.concatenate([[0], np.cumsum(~keep)])
        n_removed = total[words.first[1:]] - total[words.first[:-1]]
        ids = [None if i == _LAST else int(i) for i in chunk.ids]
        return _table(final_schema, [ids, n_words.tolist(), n_removed.tolist(), kept])

    bits = dealt.groupBy("chunk_").applyInArrow(sketch, "block_ long, chunk_ int, cells_ binary").groupBy("block_").applyInArrow(
        merge, "chunk_ int, block_ long, bits_ binary")
    entries = dealt.groupBy("chunk_").cogroup(bits.groupBy("chunk_")).applyInArrow(
        candidates, "bucket_ long, chunk_ int, keys_ binary, ids_ binary, at_ binary")
    late = entries.groupBy("bucket_").applyInArrow(group, "chunk_ int, late_ binary")
    out = dealt.groupBy("chunk_").cogroup(late.groupBy("chunk_")).applyInArrow(cut, "id_ long, n_words long, n_removed long, kept string")
    return out.select(F.col("id_").alias(id_col), "n_words", "n_removed", "kept")
