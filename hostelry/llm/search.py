"""Ranked lexical search by K2-treaps over the grid of terms and documents.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. Scores are
whole numbers: a term's weight ``w`` falls with the documents that hold it, a document's measure ``m`` grows with its
length, and an occurrence count ``tf`` has the impact ``10^9 tf div (1000 tf + 12 m)``; a document scores the sum of
weight times impact over the item's terms, repeats included.

Documents are dealt into shards as they are scanned, columns of a shard in id order. A shard's grid has a row per term
that some item of the block holds (frequent terms first, so rare rows are near each other and their cells stay empty)
and a column per document. It is kept as a quadtree of its non-empty cells, level by level: a mask of the four
children, the place of the first child, and the greatest impact in the cell. An item has one path per term,
which only ever goes to the half that holds the term's row; all its paths descend together over a document range. The
sum of weight times cell maximum bounds every score in the range, ranges are taken best bound first, and the search of
a shard ends when no range can beat the ``k``-th document found. At one column the bound is the score.

A first pass writes the postings of the item terms and counts documents, terms and holders; a second builds the treaps
and searches. Texts are never shuffled; a shard sends ``k`` rows per item, of which the best ``k`` stay. Items are
handled in blocks with a bounded number of terms, each against all documents.

Cases: null and empty texts have no terms and are not counted; a document without an item's terms has no score and
does not come; equal scores rank by id (null first), then rows that repeat an id in any order, each with a rank; items
that repeat an id are kept apart in the search and ranked together under the id; an empty table on either side gives an
empty result; other columns are ignored whatever their names; texts of any length are read whole, one at a time beyond
a million characters. Terms are compared by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hostelry.llm.frames import text_slices
from hostelry.llm.ordering import running_totals
from hostelry.llm.words import words_of
from hostelry.operators.distribution import top_per_group
from hostelry.session import discard, durable

#: Bytes that are in no term: ASCII but for letters and digits.
OUTSIDE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Documents and postings of a shard, about (the document that passes the bound is in); terms of a block of items, about.
SHARD_DOCS, SHARD_POSTINGS, BLOCK_TERMS = 16384, 3_000_000, 200_000
#: Ranges that are opened together.
BATCH = 128
_POPCOUNT = np.array([[bin(m & ((1 << c) - 1)).count("1") for c in range(4)] for m in range(16)], np.int64)


@dataclass
class Treap:
    """Cells of all levels in one row of arrays; level ``l`` has ``4^l`` places, the root is cell 0."""

    depth: int
    first: np.ndarray
    mask: np.ndarray
    top: np.ndarray


def build(rows: np.ndarray, cols: np.ndarray, impact: np.ndarray, depth: int) -> Treap:
    """``2^depth`` rows and columns. Cells are ordered along the Z curve, so a level follows from the one below it."""
    code = np.zeros(len(rows), np.int64)
    for bit in range(depth):
        code |= ((rows.astype(np.int64) >> bit & 1) << (2 * bit + 1)) | ((cols.astype(np.int64) >> bit & 1) << (2 * bit))
    order = np.argsort(code)
    code, top = code[order], impact[order]
    levels = [(np.zeros(len(code), np.int64), np.zeros(len(code), np.uint8), top)]
    for _ in range(depth):
        above = code >> 2
        begin = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
        mask = np.bitwise_or.reduceat(np.left_shift(1, code & 3).astype(np.uint8), begin)
        top = np.maximum.reduceat(top, begin)
        levels.append((begin, mask, top))
        code = above[begin]
    levels.reverse()
    sizes = np.cumsum([0, *(len(t) for _, _, t in levels)])
    # a cell's children begin in the next level, whose cells come after all cells of this one
    first = np.concatenate([f + sizes[min(i + 1, depth)] for i, (f, _, _) in enumerate(levels)])
    return Treap(depth, first, np.concatenate([m for _, m, _ in levels]), np.concatenate([t for _, _, t in levels]))


def best(treap: Treap, rows: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The ``k`` best columns with a score above 0, best first: ``(score, column)``, equal scores by column.

    Frontier: per open range its level, number, and the cell of each row (-1: nothing there).
    """
    depth = treap.depth
    bits = (rows[:, None] >> np.arange(depth - 1, -1, -1)) & 1
    weights = weights.astype(np.int64)
    level, place = np.zeros(1, np.int64), np.zeros(1, np.int64)
    cells = np.zeros((1, len(rows)), np.int64)
    bound = np.array([int((weights * treap.top[0]).sum())])
    scores, columns = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(bound):
        if len(bound) > BATCH:
            pick = np.argpartition(-bound, BATCH)[:BATCH]
            rest = np.ones(len(bound), bool)
            rest[pick] = False
        else:
            pick, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
        at, where, own = level[pick], place[pick], cells[pick]
        if depth:
            there = own >= 0
            mask = np.where(there, treap.mask[own], 0)
            begin = treap.first[own]
            half = bits[:, at].T << 1
            made = []
            for side in (0, 1):
                child = half | side
                has = (mask >> child & 1).astype(bool)
                cell = np.where(has, begin + _POPCOUNT[mask, child], -1)
                made.append((at + 1, where * 2 + side, cell, (np.where(has, treap.top[cell], 0) * weights).sum(axis=1)))
            at, where, own, worth = (np.concatenate(x) for x in zip(*made))
        else:
            worth = bound[pick]
        done = (at == depth) & (worth > 0)
        if done.any():
            scores, columns = np.concatenate([scores, worth[done]]), np.concatenate([columns, where[done]])
            order = np.lexsort((columns, -scores))[:k]
            scores, columns = scores[order], columns[order]
        go = (at < depth) & (worth > 0)
        level, place = np.concatenate([level[rest], at[go]]), np.concatenate([place[rest], where[go]])
        cells, bound = np.concatenate([cells[rest], own[go]]), np.concatenate([bound[rest], worth[go]])
        if len(scores) == k:  # equal bounds still matter where a column of the range comes before the last one found
            useful = (bound > scores[-1]) | ((bound == scores[-1]) & (place << (depth - level) < columns[-1]))
            level, place, cells, bound = level[useful], place[useful], cells[useful], bound[useful]
    return list(zip(scores.tolist(), columns.tolist(), strict=True))


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item`` (number of the row), id, ``term`` (hash), ``times``."""
    slim = items.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_")).withColumn(
        "item", F.monotonically_increasing_id())
    slim = durable(slim)
    schema = T.StructType([T.StructField("item", T.LongType()), slim.schema[id_col], T.StructField("terms", T.ArrayType(T.LongType())),
                           T.StructField("times", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            ids, numbers = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, (texts,) in text_slices(batch.column(1)):
                words = words_of(texts, lower=True, blank=OUTSIDE)
                hashes = words.hashes().view(np.int64)
                found = [np.unique(hashes[words.first[i]:words.first[i + 1]], return_counts=True) for i in range(len(texts))]
                yield pa.RecordBatch.from_pydict({
                    "item": numbers[a:a + len(texts)], id_col: ids[a:a + len(texts)],
                    "terms": [t.tolist() for t, _ in found], "times": [n.tolist() for _, n in found]}, schema=arrow)

    return slim.mapInArrow(run, schema)


def _postings(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Shards: ids of their documents with item terms, lengths, postings (term number, document, count; packed), holders
    of each term, and how many documents and terms all its texts have."""
    slim = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(slim.schema[id_col].dataType)), T.StructField("lengths", T.BinaryType()), T.StructField("term", T.BinaryType()),
        T.StructField("doc", T.BinaryType()), T.StructField("tf", T.BinaryType()), T.StructField("held", T.ArrayType(T.LongType())),
        T.StructField("docs", T.LongType()), T.StructField("terms", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        ids, parts, count, postings, n_docs, n_terms = [], [], 0, 0, 0, 0

        def shard():
            lengths, term, doc, tf = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 4
            held = np.bincount(term, minlength=len(vocabulary))
            return pa.RecordBatch.from_pydict({
                "ids": [ids], "lengths": [lengths.astype("<i8").tobytes()], "term": [term.astype("<i4").tobytes()],
                "doc": [doc.astype("<i4").tobytes()], "tf": [tf.astype("<i8").tobytes()], "held": [held.tolist()],
                "docs": [n_docs], "terms": [n_terms]}, schema=arrow)

        for batch in batches:
            names = batch.column(0)
            for a, (texts,) in text_slices(batch.column(1)):
                words = words_of(texts, lower=True, blank=OUTSIDE)
                hashes = words.hashes().view(np.int64)
                lengths = np.diff(words.first)
                n_docs += int((lengths > 0).sum())
                n_terms += len(hashes)
                number = np.searchsorted(vocabulary, hashes)
                number[number == len(vocabulary)] = 0
                mine = vocabulary[number] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
                pair, tf = np.unique(words.doc[mine].astype(np.int64) << 32 | number[mine], return_counts=True)
                doc, term = pair >> 32, pair & 0xFFFFFFFF
                used = np.unique(doc)
                ids += names.slice(a, len(texts)).take(pa.array(used)).to_pylist()
                parts.append((lengths[used].astype(np.int64), term, np.searchsorted(used, doc) + count, tf.astype(np.int64)))
                count += len(used)
                postings += len(pair)
                if count >= shard_docs or postings >= SHARD_POSTINGS:
                    yield shard()
                    ids, parts, count, postings, n_docs, n_terms = [], [], 0, 0, 0, 0
        if n_docs:
            yield shard()

    return slim.mapInArrow(run, schema)


def _search(shards: DataFrame, items: dict, weights: np.ndarray, rank: np.ndarray, docs: int, terms: int, k: int, id_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc", id_type), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                ids = shard["ids"]
                if not ids:
                    continue
                order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0))
                column = np.empty(len(ids), np.int64)
                column[order] = np.arange(len(ids))
                # in Python numbers, which do not overflow
                measure = np.array([75 + 25 * n * docs // terms for n in np.frombuffer(shard["lengths"], "<i8").tolist()], np.int64)
                term, doc, tf = (np.frombuffer(shard[c], t) for c, t in (("term", "<i4"), ("doc", "<i4"), ("tf", "<i8")))
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * measure[doc])
                depth = (max(len(weights), len(ids)) - 1).bit_length()
                treap = build(rank[term], column[doc], impact, depth)
                out = [(item, ids[order[c]], score) for item, (rows, times) in items.items()
                       for score, c in best(treap, rank[rows], weights[rows] * times, k)]
                for a in range(0, len(out), 65536):
                    part = out[a:a + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*part), arrow)], schema=arrow)

    return shards.drop("held", "docs", "terms").mapInArrow(run, schema)


def top(
    docs: DataFrame, items: DataFrame, k: int = 20, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0.

    Runs jobs: two over the items, two over the documents per block of items. What reaches the driver is one block's
    terms, with the number of documents that hold each, and sums.
    """
    spark = docs.sparkSession
    asked = _item_terms(items, item_col, text_col).where(F.size("terms") > 0)
    asked = durable(running_totals(asked, [F.col("item")], {"ahead": F.size("terms").cast("long")}).withColumn(
        "block", F.floor(F.col("ahead") / BLOCK_TERMS)))
    id_type = docs.schema[doc_col].dataType
    found = spark.createDataFrame([], T.StructType([
        T.StructField("item", T.LongType()), T.StructField("doc", id_type), T.StructField("score", T.LongType())]))
    blocks = asked.agg(F.max("block")).first()[0]
    for b in range(0 if blocks is None else blocks + 1):
        mine = [(r["item"], np.array(r["terms"]), np.array(r["times"])) for r in asked.where(F.col("block") == b).toLocalIterator()]
        if not mine:
            continue
        vocabulary = np.unique(np.concatenate([t for _, t, _ in mine]))
        own = {item: (np.searchsorted(vocabulary, t), n) for item, t, n in mine}
        shards = durable(_postings(docs, vocabulary, doc_col, text_col))
        whole = shards.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
        if not whole["terms"]:
            continue
        held = np.zeros(len(vocabulary), np.int64)
        for row in shards.select(F.posexplode("held").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
            held[row["term"]] = row["n"]
        weights = np.array([math.floor(1000 * math.log((2 * whole["docs"] + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.argsort(-held, kind="stable")] = np.arange(len(vocabulary))
        hits = top_per_group(
            _search(shards, own, weights, rank, whole["docs"], whole["terms"], k, id_type), ["item"], [F.desc("score"), F.col("doc").asc_nulls_first()], k)
        found = found.unionByName(durable(hits))
        discard(shards)
    named = found.join(asked.select("item", item_col), "item")
    ranked = top_per_group(named, [item_col], [F.desc("score"), F.col("doc").asc_nulls_first()], k, "rank")
    return ranked.select(item_col, F.col("rank").cast("int").alias("rank"), F.col("doc").alias(doc_col), "score")
