"""Quality rules: text statistics with two hard limits, and line sequence labelling.

A linear-chain conditional random field marks every line with a word as content or boilerplate, by Viterbi
over the lines of a text; a text is kept if no hard limit failed and at least half of its words lie in content
lines. The field is trained from documents with a quality label, whose lines all take that label.

Cases: null and empty texts have no words, fail the length limit and are not kept; repeated rows give repeated
results; labels may be null, repeated (the lowest counts) or missing (every line is content then); an empty
table gives an empty table; other columns are not read; very long texts are read whole, in linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostelry.llm import crf
from hostelry.llm.frames import per_document
from hostelry.llm.words import BLANK, mix, shingles, words_of

#: Labelled documents that the field is fitted to, at most; taken by the hash of the id.
MAX_LABELLED = 2_000
#: Lines of a training sequence; longer documents give several.
TRAINING_LINES = 30
#: Training sequences at most, of all labelled documents together; those with the least hash are taken.
MAX_SEQUENCES = 8_000
MIN_WORDS, MAX_REPEATED, MIN_CONTENT = 50, 0.5, 0.5


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_SYMBOL = _mask(b"#*$%&|<>")
_UPPER = _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _mask(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC2, 0xF5)))
_DIGIT = _mask(b"0123456789")
_SHOUT = _mask(b"!?")
_POINT = np.array([b < 0x80 or b >= 0xC0 for b in range(256)])
_STOP = _mask(b".!?:;\"')")

_SHARES = {
    "symbols": (0.0001, 0.01, 0.03, 0.06, 0.12), "upper": (0.0001, 0.05, 0.15, 0.3, 0.6, 0.9), "digits": (0.0001, 0.02, 0.1, 0.3),
    "shouts": (0.0001, 0.02, 0.05, 0.1), "repeated": (0.0001, 0.1, 0.3, 0.5, 0.8), "length": (2, 3, 4, 5, 6, 8, 11),
    "words": (2, 3, 5, 9, 17, 33, 65, 129), "twin": (0.5,), "stop": (0.5,), "first": (0.5,),
}
_OFFSETS = np.concatenate([[0], np.cumsum([len(v) + 1 for v in _SHARES.values()])])


@dataclass
class Lines:
    """Statistics per text, and per line with a word: its text, its words and its feature ids."""

    per_text: dict[str, np.ndarray]
    doc: np.ndarray
    words: np.ndarray
    features: np.ndarray

    def first(self, n: int) -> np.ndarray:
        return np.searchsorted(self.doc, np.arange(n + 1))


def repeated_words(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of three that its text has twice or more."""
    keys, at = shingles(hashes, doc, 3)
    keys = mix(keys ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    cover = np.zeros(len(hashes) + 1, np.int64)
    if len(twice):
        where = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        at = at[twice[where] == keys]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + 3, -1)
    return np.cumsum(cover[:-1]) > 0


def measure(texts: list[str]) -> Lines:
    words = words_of(texts)
    buf = np.frombuffer(words.raw, np.uint8)
    n = len(texts)
    text_start = np.concatenate([[0], np.cumsum([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts])])[:-1]
    breaks = np.flatnonzero(buf == 10)
    line_start = np.concatenate([[0], breaks[:-1] + 1])
    again = repeated_words(words.hashes(), words.doc)
    total = np.concatenate([[0], np.cumsum(again)])

    used, first_word, count = np.unique(np.searchsorted(breaks, words.start), return_index=True, return_counts=True)
    ends = breaks[used]
    starts = line_start[used]
    doc = words.doc[first_word]
    twin = np.zeros(len(used), bool)
    seen, at = set(), -1
    for i, (a, b, d) in enumerate(zip(starts.tolist(), ends.tolist(), doc.tolist(), strict=True)):
        if d != at:
            seen, at = set(), d
        line = words.raw[a:b]
        twin[i] = line in seen
        seen.add(line)

    def per_line(mask):
        return np.add.reduceat(mask[buf], line_start)[used] if len(used) else np.zeros(0)

    size = np.maximum(ends - starts, 1)
    letters = np.maximum(per_line(_LETTER), 1)
    symbols = np.add.reduceat(_SYMBOL[buf], line_start)
    last = words.end[first_word + count - 1] - 1 if len(used) else np.zeros(0, np.int64)
    width = np.concatenate([[0], np.cumsum(words.end - words.start)])
    values = {
        "symbols": symbols[used] / size, "upper": per_line(_UPPER) / letters, "digits": per_line(_DIGIT) / size,
        "shouts": per_line(_SHOUT) / size, "repeated": (total[first_word + count] - total[first_word]) / np.maximum(count, 1),
        "length": (width[first_word + count] - width[first_word]) / np.maximum(count, 1), "words": count, "twin": twin,
        "stop": _STOP[buf[last]], "first": np.diff(doc, prepend=-1) > 0,
    }
    features = np.stack([
        np.searchsorted(np.array(cuts), values[name], "right") + _OFFSETS[k] for k, (name, cuts) in enumerate(_SHARES.items())], axis=1)
    twins = np.bincount(doc, twin, n).astype(np.int64) if len(used) else np.zeros(n, np.int64)
    per_text = {
        "n_words": np.diff(words.first),
        "word_chars": np.add.reduceat((_POINT[buf] & ~BLANK[buf]).astype(np.int64), text_start) if n else np.zeros(0),
        "n_symbols": np.add.reduceat(_SYMBOL[buf].astype(np.int64), text_start) if n else np.zeros(0),
        "n_dup_lines": twins,
        "n_repeat_words": total[words.first[1:]] - total[words.first[:-1]],
    }
    return Lines(per_text, doc, count, features)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_labelled: int = MAX_LABELLED, max_sequences: int = MAX_SEQUENCES) -> crf.Chain:
    """Field fitted to at most ``max_sequences`` runs of ``TRAINING_LINES`` lines of at most ``max_labelled`` labelled documents.

    A job; the runs come to the driver as feature ids. An id with several texts counts once, with the first of them in order."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(
        F.col(id_col).alias("key_")).agg(F.min(label_col).cast("int").alias("label_"))
    picked = known.orderBy(F.xxhash64("key_"), "key_").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("key_"), F.col(text_col).alias("text_")).join(picked, "key_").select(
        F.struct("key_", "label_").alias("label"), F.coalesce("text_", F.lit("")).alias("text_")).groupBy("label").agg(F.min("text_").alias("text_"))

    def start():
        def function(batch):
            lines = measure(batch)
            first = lines.first(len(batch))
            return ([[lines.features[c:min(c + TRAINING_LINES, b)].ravel().tolist() for c in range(a, b, TRAINING_LINES)]
                     for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)],)

        return function

    kind = T.ArrayType(T.ArrayType(T.IntegerType()))
    runs = per_document(texts, "label", "text_", [T.StructField("runs", kind)], start).select("label", F.posexplode("runs").alias("no", "features"))
    sets = runs.orderBy(F.xxhash64("label.key_", "no"), "label.key_", "no").limit(max_sequences).collect()
    rows, labels_, lengths = [], [], []
    for row in sorted(sets, key=lambda r: (r.label.key_, r.no)):
        part = np.array(row.features, np.int64).reshape(-1, len(_SHARES))
        rows.append(part)
        lengths.append(len(part))
        labels_.append(np.full(len(part), int(row.label.label_ == 0)))
    if not rows:
        rows, labels_ = [np.zeros((0, len(_SHARES)), np.int64)], [np.zeros(0, np.int64)]
    return crf.train(np.concatenate(rows), np.concatenate(labels_), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
                     int(_OFFSETS[-1]), 2, rounds=100)


def judge(docs: DataFrame, chain: crf.Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, ``kept`` and ``content_words`` of every document."""
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def start():
        def function(texts):
            lines = measure(texts)
            marks = chain.decode(lines.features, lines.first(len(texts)))
            content = np.bincount(lines.doc, lines.words * (marks == 0), len(texts)).astype(np.int64)
            stats = lines.per_text
            words, again = stats["n_words"], stats["n_repeat_words"]
            failed = (words < MIN_WORDS) | (again > MAX_REPEATED * words)
            kept = ~failed & (content >= MIN_CONTENT * words)
            return [*(stats[n].tolist() for n in numbers), failed.tolist(), kept.tolist(), content.tolist()]

        return function

    return per_document(docs, id_col, text_col, [
        *(T.StructField(n, T.LongType()) for n in numbers), T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()), T.StructField("content_words", T.LongType())], start)
