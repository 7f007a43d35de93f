"""The corpus pipeline: from documents to token ids, in five stages.

Each stage takes all that its predecessor kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, jaccard, language, pieces, secrets
from docloom.llm.shared import saved


def _out(docs: DataFrame, name: str, *more: str) -> str:
    """A name for new columns, with these endings too, that no column of `docs` has."""
    while any((name + end).lower() in {c.lower() for c in docs.columns} for end in ("", *more)):
        name += "_"
    return name


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those that the language ID rejects go.

    Null texts and texts without a letter are rejected. Rows that repeat stay or go together.
    """
    name = _out(docs, "language", "_score", "_rejected")
    return language.identify(docs, language.fit(docs), out=name).where(~F.col(f"{name}_rejected")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    A null id comes after all others; rows that repeat are copies. Null and blank texts, which are near none, all stay.
    """
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks; into null and empty texts none does. Rows that repeat stay or go together."""
    name = _out(docs, "leaks")
    marked = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=name)
    return marked.where(F.size(name) == 0).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text, a null text stays null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_pieces, piece_ids) of each document, rows that repeat each; null texts have no ids."""
    encoded = pieces.encode_column(docs)
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("language", known_languages),
    ("near_copies", one_of_each),
    ("benchmark", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", token_ids),
]

#: SQL can't express the language ID, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = saved(docs) if k < len(STAGES) - 1 else docs
    return docs
