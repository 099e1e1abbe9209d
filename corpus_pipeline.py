"""A training corpus from raw documents: toxic documents go, then near copies, repeated passages and personal data; the
rest is packed into windows. Each stage takes and returns the columns of documents; the last returns packed pieces."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm import common, jaccard, packing, pii, substrings, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a score below 0.7; the model learns from the labels of the folder, their held-out third left out."""
    common.ship(spark)
    return toxicity.without_toxic(docs, toxicity.train_on(docs, common.table(spark, sf_dir, "labels"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row, that with the smallest id; rows without words all stay."""
    common.ship(spark)
    return _as_documents(jaccard.one_of_each(docs, ["lang", "source"]))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of windows that repeat; a text that loses none stays as it is."""
    common.ship(spark)
    kept = substrings.remove_repeats(docs, carry=["lang", "source"], keep_layout=True)
    return _as_documents(kept.withColumnRenamed("kept", "text"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data, and terms that disclose it, replaced or removed."""
    common.ship(spark)
    return _as_documents(pii.redact_documents(docs, carry=["lang", "source"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into windows of 1024 tokens."""
    common.ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: The toxicity stage's model can't be written as SQL; tests/llm hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir))
    return docs
