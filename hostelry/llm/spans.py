"""Spans found in texts: their type, their order, their digests and their removal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points, end exclusive. ``base``: found by a pattern in the text itself.
SPAN = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])


def in_order(spans: list[tuple[str, int, int, bool]], kinds: tuple[str, ...]) -> list[tuple[str, int, int, bool]]:
    """By start, then by kind as listed, then by end."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digests(found: DataFrame, kinds: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as a string."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col, *map(count, kinds), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def code_points(raw: bytes) -> np.ndarray:
    """Code points that begin before each byte position."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=out[1:])
    return out


def blanked(text: str, spans: list[tuple[str, int, int, bool]], mask: str) -> str:
    """The text with every span, or run of overlapping spans, replaced by ``mask``."""
    out, at = [], 0
    for _, start, end, _ in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
