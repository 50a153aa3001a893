"""From raw documents to tokens: five stages, each on all that its predecessor kept.

Every stage is one operator of ``hostelry.llm`` with production parameters. It takes ``(spark, docs, folder)`` and
returns a table; all but the last return the columns of ``documents``. ``run`` writes each stage as Parquet in the
shared folder that ``spark.checkpoint.dir`` names and reads it again, so a lost executor costs no earlier stage.

1. ``toxicity``: documents that the scorer, fitted to the labels of the documents it gets, predicts as toxic go.
2. ``near_duplicates``: of each class of near copies (five-word shingles, similarity 0.8) one document stays, the
   one with the smallest id; documents without words stay.
3. ``decontamination``: documents with a passage of a benchmark item go.
4. ``secrets``: every secret in a text is replaced by ``[SECRET]``, and ``n_chars`` counts the new text.
5. ``tokens``: ``doc_id``, ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit integers).

Null texts pass as null until the last stage, which reads them as empty. Rows with equal ids share the fate of
their id; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostelry.llm import bpe, decontamination, near_duplicates, secrets, toxicity
from hostelry.session import durable

#: No SQL: the scorer is a fitted model and the tokens need a vocabulary. Tests compare each stage with brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is not in the one column of ``ids``."""
    gone = ids.toDF("gone_id").where("gone_id is not null").distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return _without(docs, scored.where("predicted = 1").select("doc_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    found = near_duplicates.classes(docs, n=5, similarity=0.8)
    return _without(docs, found.where("not kept").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return decontamination.remove(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("tokens", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
