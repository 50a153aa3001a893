"""Training passages that copy benchmark items, also edited or paraphrased.

1. Word n-grams of the items, of whole words and of first four letters, are looked up in every document, through a table of fixed size that lets every
   true hit pass and says how long the items with the seed get. Hits that one item can reach both of form a passage,
   which goes on with its words and, on both sides, as many more as an alignment of those items can reach: an item of
   any length lengthens only the passages that have its seeds. Equal passages are handled once, however many documents have them.
2. Passages join items on the rare seeds of each item, as the passages count them: all but so many of its commonest ones
   that a pair with enough seeds to be aligned cannot have those alone. So rarity leaves no pair out, also where
   an item or its copies have common seeds only. The common seeds are looked up for joined pairs alone.
3. A pair with two seeds of whole words close to one diagonal, or with a quarter of the item's seeds, is aligned word by word (Smith-Waterman, batches in numpy):
   2 for the same word, 1 for the same first four letters, -1 for another word or a gap. The score is the best local
   alignment over that of the whole item; from ``threshold`` on the document counts as contaminated.

Words are runs of letters and digits in lower case (A-Z), so changed punctuation changes nothing.

Limit: a copy is never aligned, whatever it would score, without two places where ``n`` words in a row are the same, or a
quarter of the item's places where they keep their first four letters and differ in them from each other (every third
word replaced by an unlike one, say). A seed that an item repeats counts at its first place.

Cases: null and empty texts match nothing; items with fewer words than a seed are never found; repeated rows of
either table give one row per document and item id, with the best score; null ids are ids; extra columns are not
read; an empty table on either side gives an empty table; very long texts are searched whole.
"""

from __future__ import annotations

import zlib
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostelry.llm.frames import give_back, per_document
from hostelry.llm.words import BLANK, Words, mix, shingles, words_of
from hostelry.operators.distribution import attach, spread_join
from hostelry.session import durable

SEED = 3
THRESHOLD = 0.5
#: Without enough seeds of whole words, one place in so many of the item must be hit: texts can share beginnings by chance.
BEGUN_SHARE = 4
#: Places of the table of seeds, a byte each; more seeds let more false hits pass, which the join then drops.
BITS = 1 << 23
#: Diagonals this close belong to one alignment, and words read beyond its ends.
SLACK = 12
#: Items whose words a task remembers.
ITEMS = 512

#: Keeps seeds of beginnings apart from those of whole words, also where all words are short.
_BEGUN = np.uint64(0x5851F42D4C957F2D)
_NO_WORD = BLANK.copy()
_NO_WORD[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def tokens(texts: list[str]) -> Words:
    return words_of(texts, lower=True, blank=_NO_WORD)


def _seeds(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and first words of all windows, in order of place, and which are of whole words; the others are of
    beginnings, if no two are the same."""
    whole, at = shingles(words.hashes(), words.doc, n)
    begins = words.hashes(4)
    begun, _ = shingles(begins, words.doc, n)
    apart = np.ones(len(at), bool)
    for i in range(n):
        for j in range(i):
            apart &= begins[at + i] != begins[at + j]
    keep = np.stack([np.ones(len(at), bool), apart], axis=1).ravel()
    return np.stack([whole, mix(begun + _BEGUN)], axis=1).ravel()[keep], np.repeat(at, 2)[keep], np.tile([True, False], len(at))[keep]


def seeds_of(items: DataFrame, text_col: str, n: int) -> DataFrame:
    """``key_, seed_, whole_, at_, last_``: the n-grams of each item, at their first place, and their last place."""
    def start():
        def function(texts):
            words = tokens(texts)
            hashes, at, whole = _seeds(words, n)
            cuts = np.searchsorted(at, words.first)
            return ([[{"seed_": int(h), "at_": int(p), "whole_": bool(w)}
                      for h, p, w in zip(hashes[a:b].view(np.int64), at[a:b] - first, whole[a:b], strict=True)]
                     for a, b, first in zip(cuts[:-1], cuts[1:], words.first[:-1], strict=True)],)

        return function

    kind = T.ArrayType(T.StructType([T.StructField("seed_", T.LongType()), T.StructField("at_", T.IntegerType()), T.StructField("whole_", T.BooleanType())]))
    found = per_document(items, "key_", text_col, [T.StructField("seeds_", kind)], start)
    return found.select("key_", F.explode("seeds_").alias("s")).groupBy("key_", F.col("s.seed_").alias("seed_"), F.col("s.whole_").alias("whole_")).agg(
        F.min("s.at_").alias("at_"), F.max("s.at_").alias("last_"))


def reach_table(seeds: DataFrame, n: int, bits: int = BITS) -> np.ndarray:
    """How far an alignment of an item with the seed can reach, as a power of two: 0 where no seed is, else the least k
    with 2^k words enough for the longest of them. What comes to the driver is bounded by ``bits``."""
    longest = seeds.groupBy("key_").agg(F.ceil(F.log2(F.max("last_") + (n + SLACK))).cast("int").alias("power_"))
    found = attach(seeds, longest, ["key_"]).groupBy(F.pmod("seed_", F.lit(bits)).cast("int").alias("place")).agg(F.max("power_").alias("power")).toArrow()
    table = np.zeros(bits, np.uint8)
    table[found["place"].to_numpy()] = found["power"].to_numpy()
    return table


def runs(doc: np.ndarray, low: np.ndarray, place: np.ndarray, high: np.ndarray) -> np.ndarray:
    """First hits of passages. ``low`` and ``high``: how far back and on each hit reaches; two hits belong together if
    each reaches the other, and so does everything between them."""
    on, back = np.maximum.accumulate(high), np.minimum.accumulate(low[::-1])[::-1]
    return np.flatnonzero((np.diff(doc) > 0) | (on[:-1] < place[1:]) | (back[1:] > place[:-1])) + 1


def _passages(docs: DataFrame, table: np.ndarray, n: int, least: int) -> DataFrame:
    """``key_, id_, text_, hits_`` of passages: hits in reach of each other, with as many words on both sides.

    Places are those in the passage. Hits further apart never belong to one alignment, so a passage with hits at fewer
    than ``least`` places is in no pair.
    """
    packed = zlib.compress(table.tobytes(), 1)
    size = len(table)

    def start():
        known = np.frombuffer(zlib.decompress(packed), np.uint8)

        def function(texts):
            words = tokens(texts)
            hashes, at, _ = _seeds(words, n)
            # the remainder of the signed value, as the table has it
            power = known[hashes.view(np.int64) % size]
            hit = np.flatnonzero(power)
            doc, place, seed = words.doc[at[hit]], at[hit], hashes[hit].view(np.int64)
            reach = np.left_shift(1, power[hit].astype(np.int64))
            low, high = np.maximum(place - reach, words.first[doc]), np.minimum(place + n + reach, words.first[doc + 1]) - 1
            cuts = runs(doc, low, place, high)
            out = [[] for _ in texts]
            for a, b in zip([0, *cuts], [*cuts, len(hit)], strict=True):
                if b == a or len(np.unique(place[a:b])) < least:
                    continue
                first, last = low[a:b].min(), high[a:b].max()
                out[doc[a]].append({
                    "text_": words.raw[words.start[first]:words.end[last]].decode("utf-8", "surrogatepass"),
                    "hits_": [{"seed_": int(h), "at_": int(p)} for h, p in zip(seed[a:b], place[a:b] - first, strict=True)]})
            return [out]

        return function

    hits = T.ArrayType(T.StructType([T.StructField("seed_", T.LongType()), T.StructField("at_", T.IntegerType())]))
    kind = T.ArrayType(T.StructType([T.StructField("text_", T.StringType()), T.StructField("hits_", hits)]))
    found = per_document(docs, "id_", "text_", [T.StructField("passages_", kind)], start)
    return found.select("id_", F.inline("passages_")).select(F.xxhash64("text_").alias("key_"), "id_", "text_", "hits_")


def align(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair of word sequences.

    A sequence has one row per word: the hash of the word and that of its beginning. Pairs are aligned together,
    one word of ``one`` at a time; gaps along ``other`` resolve by a running maximum.
    """
    n, m = max((len(x) for x in one), default=0), max((len(x) for x in other), default=0)
    if not n or not m:
        return np.zeros(len(one))
    a, b = np.zeros((len(one), n, 2), np.uint64), np.ones((len(one), m, 2), np.uint64)
    for i, (x, y) in enumerate(zip(one, other, strict=True)):
        a[i, :len(x)], b[i, :len(y)] = x, y
    inside = np.arange(m) < np.array([len(y) for y in other])[:, None]
    sizes = np.array([len(x) for x in one])
    row, best, steps = np.zeros((len(one), m + 1)), np.zeros(len(one)), np.arange(m + 1)
    for i in range(n):
        same = np.where(b[:, :, 0] == a[:, i, None, 0], 2, np.where(b[:, :, 1] == a[:, i, None, 1], 1, -1))
        new = np.maximum(row - 1, 0)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + same)
        new[:, 1:] *= inside
        new = np.maximum.accumulate(new + steps, axis=1) - steps
        row = np.where((i < sizes)[:, None], new, row)
        best = np.maximum(best, np.where(i < sizes, row.max(axis=1), 0))
    return best


def windows(at: np.ndarray, item_at: np.ndarray, whole: np.ndarray, size: int, need: int, many: int) -> list[tuple[int, int]]:
    """Parts of a document, in words, where seeds of an item lie close to one diagonal: ``need`` of whole words, or ``many`` of any kind."""
    diagonal = at - item_at
    order = np.argsort(diagonal, kind="stable")
    out = []
    for group in np.split(order, np.flatnonzero(np.diff(diagonal[order]) > SLACK) + 1):
        if len(np.unique(item_at[group][whole[group]])) >= need or len(np.unique(item_at[group])) >= many:
            out.append((max(0, int(diagonal[group].min()) - SLACK), int(diagonal[group].max()) + size + SLACK))
    return out


def _alike(order: list[int], one: list[np.ndarray], other: list[np.ndarray]) -> list[list[int]]:
    """Up to 128 pairs that are aligned together, of like sizes: none waits for one much longer than itself."""
    parts = []
    for k in order:
        if parts and len(parts[-1]) < 128 and all(len(x[k]) <= 2 * len(x[parts[-1][0]]) + 16 for x in (one, other)):
            parts[-1].append(k)
        else:
            parts.append([k])
    return parts


def _item_words(text: str) -> np.ndarray:
    words = tokens([text])
    return np.stack([words.hashes(), words.hashes(4)], axis=1)


def with_rarity(seeds: DataFrame, usual: DataFrame, each: DataFrame) -> DataFrame:
    """The seeds of items that occur in ``each``, and which of them are ``common_``.

    A pair is aligned from ``need_`` places with seeds of whole words on, or from ``many_`` places of any kind. Common are the
    ``need_`` - 1 seeds of whole words and the ``many_`` - ``need_`` of beginnings that occur most often. They are fewer than
    either bound, so a pair that reaches one has a seed that is not common.
    """
    counts = each.groupBy("seed_").agg(F.count("*").alias("times_"))
    counted = attach(attach(seeds, counts, ["seed_"]).where(F.col("times_").isNotNull()), usual, ["key_"])
    rank = F.row_number().over(Window.partitionBy("key_", "whole_").orderBy(F.col("times_").desc(), "seed_"))
    spare = F.when(F.col("whole_"), F.col("need_") - 1).otherwise(F.col("many_") - F.col("need_"))
    return counted.select("seed_", F.col("key_").alias("item_key_"), F.col("at_").alias("item_at_"), "whole_", "need_", "many_", (rank <= spare).alias("common_"))


def _pairs(each: DataFrame, wanted: DataFrame) -> DataFrame:
    """Passages and items with enough seeds to be aligned: ``key_, item_key_, need_, many_, places_, seeds_``."""
    place = F.struct("place_", "item_at_", "whole_")
    rare = spread_join(each, wanted.where("not common_"), ["seed_"])
    first = durable(rare.groupBy("key_", "item_key_").agg(
        F.max("need_").alias("need_"), F.max("many_").alias("many_"), F.collect_list(place).alias("rare_")))
    open_ = spread_join(first.select("key_", "item_key_"), wanted.where("common_").select("item_key_", "seed_", "item_at_", "whole_"), ["item_key_"])
    more = spread_join(open_, each, ["key_", "seed_"]).groupBy("key_", "item_key_").agg(F.collect_list(place).alias("more_"))
    both = attach(first, more, ["key_", "item_key_"]).withColumn("places_", F.when(F.col("more_").isNull(), F.col("rare_")).otherwise(F.concat("rare_", "more_")))

    def distinct(places):
        return F.size(F.array_distinct(F.transform(places, lambda p: p["item_at_"]))).cast("long")

    wholes = distinct(F.filter("places_", lambda p: p["whole_"]))
    return both.select("key_", "item_key_", "need_", "many_", "places_", distinct(F.col("places_")).alias("seeds_"), wholes.alias("wholes_")).where(
        (F.col("wholes_") >= F.col("need_")) | (F.col("seeds_") >= F.col("many_"))).drop("wholes_")


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", n: int = SEED, threshold: float = THRESHOLD,
) -> DataFrame:
    """``id, item, score, seeds``: one row per contaminated document and item. ``seeds``: the most places of the item that a passage hits."""
    items = durable(benchmark.select(F.col(item_col).alias("item_"), F.coalesce(F.col(item_text), F.lit("")).alias("item_text_")).distinct().withColumn(
        "key_", F.xxhash64("item_", "item_text_")))
    seeds = durable(seeds_of(items, "item_text_", n))
    slim = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    places = F.count_distinct("at_")
    usual = seeds.groupBy("key_").agg(
        F.least(F.lit(2), places).alias("need_"), F.greatest(F.least(F.lit(2), places), F.ceil(places / BEGUN_SHARE)).alias("many_"))
    least = usual.agg(F.min("need_").alias("least")).first().least
    hits = durable(_passages(slim, reach_table(seeds, n), n, least or 1))

    once = hits.dropDuplicates(["key_"])
    each = durable(once.select("key_", F.explode("hits_").alias("h")).select("key_", F.col("h.seed_").alias("seed_"), F.col("h.at_").alias("place_")))
    pairs = _pairs(each, durable(with_rarity(seeds, usual, each)))
    full = attach(attach(pairs, once.select("key_", "text_"), ["key_"]), items.select(F.col("key_").alias("item_key_"), "item_", "item_text_"), ["item_key_"])
    schema = T.StructType([full.schema["key_"], full.schema["item_"], T.StructField("score", T.DoubleType()), T.StructField("seeds", T.LongType())])

    def run(batches):
        for batch in batches:
            rows = {name: batch.column(name) for name in batch.schema.names}
            need, many, seen = (rows[c].to_pylist() for c in ("need_", "many_", "seeds_"))
            places, texts, wanted = (rows[c].to_pylist() for c in ("places_", "text_", "item_text_"))
            score, known = np.zeros(batch.num_rows), {}
            for low in range(0, batch.num_rows, 64):
                high = min(low + 64, batch.num_rows)
                words = tokens(texts[low:high])
                both = np.stack([words.hashes(), words.hashes(4)], axis=1)
                one, other, owner = [], [], []
                for i in range(low, high):
                    if wanted[i] not in known:
                        if len(known) == ITEMS:
                            known.clear()
                        known[wanted[i]] = _item_words(wanted[i])
                    item = known[wanted[i]]
                    at = np.array([p["place_"] for p in places[i]])
                    item_at = np.array([p["item_at_"] for p in places[i]])
                    whole = np.array([p["whole_"] for p in places[i]])
                    first, last = words.first[i - low], words.first[i - low + 1]
                    for a, b in windows(at, item_at, whole, len(item), need[i], many[i]):
                        one.append(item)
                        other.append(both[first + a:min(first + b, last)])
                        owner.append(i)
                order = sorted(range(len(one)), key=lambda k: (len(one[k]), len(other[k])))
                for part in _alike(order, one, other):
                    best = align([one[k] for k in part], [other[k] for k in part])
                    np.maximum.at(score, [owner[k] for k in part], best / (2 * np.array([len(one[k]) for k in part])))
            keep = np.flatnonzero(score >= threshold)
            yield pa.RecordBatch.from_arrays([
                rows["key_"].take(pa.array(keep)), rows["item_"].take(pa.array(keep)), pa.array(score[keep]),
                pa.array([seen[i] for i in keep], pa.int64())], ["key_", "item_", "score", "seeds"])
        give_back()

    return spread_join(hits.select("key_", "id_"), full.mapInArrow(run, schema), ["key_"]).groupBy(F.col("id_").alias(id_col), F.col("item_").alias(item_col)).agg(
        F.max("score").alias("score"), F.max("seeds").alias("seeds"))


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` whose id is not that of a contaminated document."""
    name = f"bad_{uuid4().hex}"  # no column of docs has it
    bad = durable(find(docs, benchmark, id_col, text_col, **more).select(F.col(id_col).alias(name)).distinct())
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
