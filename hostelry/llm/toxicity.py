"""Toxicity scores: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon is learned: terms (runs of letters in lower case, and their first 3 to 7 bytes, so inflected forms
count) that far more toxic than clean labelled texts have. To keep a row's own label out of its features, the
training rows are in two folds and each fold is measured with the lexicon of the other; texts are scored with the
lexicon of both. Features are densities and rates, so the length of a text does not matter to them.

Fitting takes at most ``max_labelled`` labelled rows. Without rows of both labels every score is the share of
label 1 (0 without rows).

Cases: null and empty texts have zero features and get a score; repeated rows give repeated results; labels may be
null or repeated (the highest counts); an empty table gives an empty table; other columns of the documents are
not read, and extra columns of the labels are ignored; very long texts are read whole, in linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostelry.llm.frames import per_document, text_slices
from hostelry.llm.words import LOWER, words_of
from hostelry.session import durable

#: Labelled rows used for fitting, at most (by the hash of the id), and terms of a lexicon, at most.
MAX_LABELLED = 12_000
MAX_TERMS = 4_000
PREFIXES = (3, 4, 5, 6, 7)
#: Words between a term and a second-person word that count as near.
NEAR = 6
TREES, DEPTH = 20, 3

# Second-person words.
SECOND_PERSON = ("you", "your", "yours", "youre", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
                 "sie", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "usted", "ti", "tus", "vos")

_LETTERS = np.zeros(256, bool)
_LETTERS[list(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0x80, 0x100)))] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_INNER = np.zeros(256, bool)  # signs that hide letters inside a word
_INNER[list(b"*@$#0123456789+!|_")] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True

FEATURES = ("strong", "weak", "strong_count", "near_person", "person", "capitals", "capital_words", "shouts", "punctuation",
            "hidden", "stretched", "size")


def _sorted_hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(words_of([" ".join(words)]).hashes())


_PERSON = _sorted_hashes(SECOND_PERSON)


@dataclass
class Lexicon:
    strong: np.ndarray
    weak: np.ndarray


class _Known:
    """Membership in a set of hashes: a bit table answers most, the sorted set the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys.astype(np.uint64))
        self.table = np.zeros(1 << 18, bool)
        self.table[(self.keys & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        if len(self.keys):
            maybe = np.flatnonzero(self.table[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
            where = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            out[maybe[self.keys[where] == hashes[maybe]]] = True
        return out


def _terms(tokens):
    """Hashes of every token and of its beginnings, each with the tokens it is for."""
    size = tokens.end - tokens.start
    yield tokens.hashes(), np.arange(len(size))
    for k in PREFIXES:
        longer = np.flatnonzero(size > k)
        # a beginning is another term than the word that looks like it
        yield tokens.hashes(k)[longer] ^ np.uint64(k), longer


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[first[1:]] - total[first[:-1]]).astype(np.float64)


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """Texts × ``FEATURES``."""
    words, tokens = words_of(texts), words_of(texts, lower=True, blank=~_LETTERS)
    buf = np.frombuffer(words.raw, np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])])
    strong, weak = np.zeros(len(tokens.start), bool), np.zeros(len(tokens.start), bool)
    is_strong, is_weak = _Known(lexicon.strong), _Known(lexicon.weak)
    for hashes, owners in _terms(tokens):
        strong[owners[is_strong(hashes)]] = True
        weak[owners[is_weak(hashes)]] = True
    person = _Known(_PERSON)(tokens.hashes())
    near = np.zeros(len(person), bool)
    spots = np.flatnonzero(person)
    hits = np.flatnonzero(strong)
    if len(spots) and len(hits):
        at = np.searchsorted(spots, hits)
        for side in (np.maximum(at - 1, 0), np.minimum(at, len(spots) - 1)):
            other = spots[side]
            near[hits[(np.abs(other - hits) <= NEAR) & (tokens.doc[other] == tokens.doc[hits])]] = True
    letters, upper = _LETTERS[buf], _UPPER[buf]
    ups = np.concatenate([[0], np.cumsum(upper)])
    alls = np.concatenate([[0], np.cumsum(letters)])
    capital = (ups[words.end] - ups[words.start] >= 2) & (ups[words.end] - ups[words.start] == alls[words.end] - alls[words.start])
    hide = np.zeros(len(buf), bool)
    hide[1:-1] = _INNER[buf[1:-1]] & letters[:-2] & letters[2:]
    low = LOWER[buf]
    same = np.zeros(len(buf), bool)
    same[2:] = letters[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (low[2:] < 0x80)
    n_tokens = np.maximum(np.diff(tokens.first), 1)
    n_words = np.maximum(np.diff(words.first), 1)
    n_bytes = np.maximum(np.diff(edges) - 1, 1)
    n_letters = np.maximum(_sums(letters, edges), 1)
    n_strong = _sums(strong, tokens.first)
    return np.stack([
        n_strong / n_tokens, _sums(weak, tokens.first) / n_tokens, np.log1p(n_strong), _sums(near, tokens.first) / np.maximum(n_strong, 1),
        _sums(person, tokens.first) / n_tokens, _sums(upper, edges) / n_letters, _sums(capital, words.first) / n_words,
        _sums(_SHOUT[buf], edges) / n_bytes, _sums(_PUNCTUATION[buf], edges) / n_bytes, _sums(hide, edges) / n_words,
        _sums(same, edges) / n_words, np.log1p(np.diff(words.first)),
    ], axis=1)


def remainder(id_col: str) -> Column:
    """crc32 of the id as text; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int) -> DataFrame:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(id_col) % 3 != 1)).groupBy(
        F.col(id_col).alias("key_")).agg(F.max(label_col).cast("int").alias("label_"))
    picked = known.orderBy(F.xxhash64("key_"), "key_").limit(max_labelled)
    found = docs.select(F.col(id_col).alias("key_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_")).join(picked, "key_").select(
        F.struct("key_", "label_", (remainder("key_") / 3).cast("long").alias("part_")).alias("label"), "text_")
    # an id with several texts counts once, with the first of them in order
    return durable(found.groupBy("label").agg(F.min("text_").alias("text_")))  # a bounded sample, read four times


def learn_lexicons(rows: DataFrame, max_terms: int = MAX_TERMS) -> dict[int, Lexicon]:
    """Lexicons of fold 0, of fold 1 and of both (2), from labelled rows.

    A term's standing is the log odds ratio of the texts that have it, over its standard error.
    """
    schema = "term long, fold int, toxic long, clean long"

    def count(batches):
        for batch in batches:
            info = batch.column(0)
            label = np.array(info.field("label_").to_pylist(), np.int64)
            fold = np.array(info.field("part_").to_pylist(), np.int64) // 4 % 2
            for a, (texts,) in text_slices(batch.column(1)):
                tokens = words_of(texts, lower=True, blank=~_LETTERS)
                keys, owner = [], []
                for hashes, owners in _terms(tokens):
                    order = np.lexsort((hashes, tokens.doc[owners]))
                    term, doc = hashes[order], tokens.doc[owners[order]]
                    new = np.ones(len(order), bool)
                    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
                    keys.append(term[new])
                    owner.append(doc[new] + a)
                keys, owner = np.concatenate(keys), np.concatenate(owner)
                group = label[owner] * 2 + fold[owner]
                order = np.argsort(keys)
                terms, new = keys[order], np.ones(len(keys), bool)
                new[1:] = terms[1:] != terms[:-1]
                terms, where, group = terms[new], np.cumsum(new) - 1, group[order]
                counts = np.stack([np.bincount(where[group == g], minlength=len(terms)) for g in range(4)], axis=1)
                for f in (0, 1):
                    some = counts[:, f] + counts[:, 2 + f] > 0
                    yield pa.RecordBatch.from_arrays([
                        pa.array(terms[some].view(np.int64)), pa.array(np.full(some.sum(), f, np.int32)),
                        pa.array(counts[some, 2 + f]), pa.array(counts[some, f])], ["term", "fold", "toxic", "clean"])

    info = rows.groupBy((F.col("label.part_") / 4).cast("long") % 2, "label.label_").count().collect()
    size = {(int(r[0]), int(r[1] == 1)): r["count"] for r in info}
    counted = rows.select("label", F.col("text_")).mapInArrow(count, schema).groupBy("term").agg(*(
        F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in (0, 1) for c in ("toxic", "clean")))
    out = {}
    for fold, parts in ((0, (0,)), (1, (1,)), (2, (0, 1))):
        toxic, clean = (sum((F.col(f"{c}{p}") for p in parts), F.lit(0)) for c in ("toxic", "clean"))
        n_toxic, n_clean = (sum(size.get((p, k), 0) for p in parts) for k in (1, 0))
        odds = F.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - F.log((clean + 0.5) / (n_clean - clean + 0.5))
        standing = odds / F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        kept = counted.where((toxic >= 3) & (odds > 2) & (standing > 2)).select("term", standing.alias("z")).orderBy(
            F.desc("z"), "term").limit(max_terms).collect()
        terms = np.array([r.term for r in kept], np.int64).view(np.uint64)
        z = np.array([r.z for r in kept])
        out[fold] = Lexicon(terms[z > 3.3] if len(z) else terms, terms)
    return out


@dataclass
class Model:
    """A fitted scorer; without trees every score is ``base``."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base: float


_FIELDS = [T.StructField(name, T.DoubleType()) for name in FEATURES]


def _measured(docs: DataFrame, id_col: str, text_col: str, lexicon: Lexicon) -> DataFrame:
    def start():
        return lambda texts: features(texts, lexicon).T.tolist()

    return per_document(docs, id_col, text_col, _FIELDS, start)


def _margin(df: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features_").transform(df)
    return trees.transform(ready).withColumn("margin_", vector_to_array("rawPrediction")[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_labelled: int = MAX_LABELLED) -> Model:
    """Scorer fitted to labelled rows whose ``crc32(id) % 3`` is not 1. A quarter of them calibrates, the rest grows trees."""
    rows = _labelled(docs, labels, id_col, text_col, label_col, max_labelled)
    counts = {int(r["label_"]): r["count"] for r in rows.groupBy("label.label_").count().collect()}
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.uint64)), None, None, base)
    lexicons = learn_lexicons(rows)
    fold = (F.col("label.part_") / 4).cast("long") % 2
    measured = _measured(rows.where(fold == 0), "label", "text_", lexicons[1]).unionByName(
        _measured(rows.where(fold == 1), "label", "text_", lexicons[0]))
    measured = measured.select(F.col("label.label_").cast("double").alias("label_"), (F.col("label.part_") % 4 == 0).alias("calibrates"),
                               F.col("label.key_").alias("key_"), *FEATURES)
    # bounded by max_labelled rows of a dozen numbers; as a local table, fitting does not read the texts again
    spark = docs.sparkSession
    table = spark.createDataFrame(sorted(measured.collect(), key=lambda r: r.key_), measured.schema).repartition(2, "key_").sortWithinPartitions("key_")
    grown, rest = table.where(~F.col("calibrates")), table.where("calibrates")
    if grown.select("label_").distinct().count() < 2 or rest.select("label_").distinct().count() < 2:
        grown = rest = table
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features_").transform(grown)
    trees = GBTClassifier(featuresCol="features_", labelCol="label_", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7).fit(ready)
    calibration = IsotonicRegression(featuresCol="margin_", labelCol="label_").fit(_margin(rest, trees).select("margin_", "label_"))
    return Model(lexicons[2], trees, calibration, base)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id``, ``score`` from 0 to 1, ``predicted`` (1 if the score is ``threshold`` or more) and the features."""
    measured = _measured(docs, id_col, text_col, model.lexicon)
    if model.trees is None:
        scored = measured.withColumn("score", F.lit(float(model.base)))
    else:
        scored = model.calibration.setPredictionCol("calibrated_").transform(_margin(measured, model.trees)).withColumn(
            "score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated_"))))
    return scored.select(id_col, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *FEATURES)
