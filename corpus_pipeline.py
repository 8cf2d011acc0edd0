"""A training corpus from raw documents, in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakemill.llm.mixing import mixed_documents
from lakemill.llm.packing import pack
from lakemill.llm.pii import redact
from lakemill.llm.simhash import one_of_each
from lakemill.llm.store import fresh_path, remove, scratch
from lakemill.llm.toxicity import score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, trained on the labels of these documents, calls toxic go.

    Null texts are empty and stay; rows with a null or repeated id are judged by their own texts. No rows in, none out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, labels, keep=tuple(docs.columns)).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) one row stays: that of the smallest id.

    Texts without words are one group. Rows without an id come last, and of several rows of the smallest id the same one
    stays in every run; an id that repeats with another text is another document. No rows in, none out.
    """
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kinds in brackets; every row stays, null texts, null and repeated ids too.

    ``n_chars`` follows the text. No rows in, none out.
    """
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words are never taken.

    A null source is the last of the sources; rows with a null or repeated id are rows of their own. No rows in, none out.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1,024 tokens.

    Null texts are one token, the end; rows that repeat, as copies do, are packed each. No rows in, none out.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL can't express hashed models, fingerprints or tokenizers; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in ``sf_dir``. Stages and their scratch tables go when the next stage is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.schema(made.schema).parquet(path), path
    return docs
