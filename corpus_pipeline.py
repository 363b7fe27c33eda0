"""A corpus pipeline of five stages, each applying one operator to all that its predecessor kept.

A stage is written as Parquet and read again as the next one's input; what it read is removed
then, unless it is the corpus itself. The first four return the columns of ``documents``, whatever
columns the input has beside doc_id, text and source; the last one returns token ids and digests.

* A null text is an empty one: it has no words, so the quality rules reject it. A null doc_id or
  source is a value of its own. A very long text is one row like any other.
* Rows that differ in any column, be it only in where a null is, are different rows; rows that are
  equal in every column are one group of near-duplicates, of which one row stays.
* Of a group, the row with the smallest doc_id stays (null last); ties go by a hash of the row.
* An empty table passes all stages and gives an empty one.
* Columns may have any names, also those that operators use; if ``n_chars`` is there, it follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posthorn.llm import mixing, piece_bpe, quality_rules, secrets, simhash
from posthorn.llm.queries import model_file
from posthorn.plans.scratch import drop, new_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps; rules are evaluated once, into a ledger beside the rows."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secret values replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of their slots."""
    return mixing.mixed_documents(docs, ordered=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their number and digests of ids and decoded text."""
    return piece_bpe.encode(docs, model_file(), keys=("doc_id", "source"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("secrets", secret_values),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL can't express the encoder, the mix's shuffle or the fingerprints' components.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            path = new_path(spark, f"stage-{n}")
            docs.write.parquet(path)
            if n:
                drop(spark, read)
            docs = read = spark.read.schema(docs.schema).parquet(path)
    return docs
