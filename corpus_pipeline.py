"""A training-data pipeline: five stages over the table of documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sabermill.llm.decontaminate import clean
from sabermill.llm.langid import identified, train
from sabermill.llm.linededup import added_columns, passage_dedup
from sabermill.llm.packing import pack
from sabermill.llm.shared import Scratch
from sabermill.llm.simhash import near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; null texts, texts without a letter and undecided texts go. Without any labelled text, all with a letter stay."""
    model = train(docs, F.lit(True))
    return docs.where("false") if model is None and docs.isEmpty() else docs.where(F.col("text").rlike(r"\p{L}")) if model is None else identified(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of two or more non-blank lines, found by content-defined chunks and carried on to their ends; documents of which nothing but white space is left go. n_chars follows the text."""
    cut, removed = passage_dedup(docs, Scratch(spark)), added_columns(docs.columns)[0]
    left = cut.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\s]"))
    length = F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return left.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    gone = near_copies(docs, Scratch(spark), words=5, similarity=0.8).where("id <> component").select(F.col("id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a benchmark window of ten words."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full windows of 2048 tokens, mixed by source as in the data."""
    return pack(docs, Scratch(spark))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("simhash", simhash), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
