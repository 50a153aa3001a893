"""Running a function of texts over documents in Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of text handled at once in a task. A longer text is handled alone.
CHUNK_CHARS = 1_000_000


def ranges(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive entries whose sizes add up to about ``limit``."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` characters each."""
    return ranges([len(t) for t in texts], limit)


def text_slices(*columns: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[list[str]]]]:
    """Parts of Arrow text columns (without nulls) as lists, with the row they begin at; only one part is ever unpacked."""
    sizes = [sum(row) for row in zip(*(pc.binary_length(c).to_pylist() for c in columns), strict=True)]
    for a, b in ranges(sizes, limit):
        yield a, [c.slice(a, b - a).to_pylist() for c in columns]


def give_back() -> None:
    """Returns freed memory to the machine. Workers live on after a task, and an executor's memory counts what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def per_document(
    docs: DataFrame, id_col: str, text_col: str, fields: list[T.StructField], start: Callable[[], Callable],
) -> DataFrame:
    """One output row per input row: the id, then ``fields``.

    ``start()`` runs once in each task and returns the function that takes a list of texts (null: empty)
    and returns one list or Arrow array per field. No other column of ``docs`` is read, so their names
    cannot clash. A task holds one batch and what the function makes of ``CHUNK_CHARS`` of it.
    """
    slim = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    schema = T.StructType([slim.schema[0], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        function = start()
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, (texts,) in text_slices(column):
                made = function(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, len(texts)).cast(arrow.field(0).type)] + [
                        value.cast(f.type) if isinstance(value, pa.Array) else pa.array(value, type=f.type)
                        for value, f in zip(made, list(arrow)[1:], strict=True)],
                    schema=arrow)
        give_back()

    return slim.mapInArrow(run, schema)


def empty_as_blank(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(name), F.lit("")))
