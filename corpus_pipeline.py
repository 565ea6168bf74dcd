"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm import bpe, decontam, fertility, langid, ngram_join
from grove.llm.common import crc_bucket, load, shared_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, fitted on labelled rows of four hash folds of
    five, does not reject.  Without a labelled row there is no model and nothing is judged."""
    model = langid.fit(docs, crc_bucket("doc_id", 5) != 0)
    if model is None:
        return docs.select(*COLUMNS)
    return langid.predict(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tokeniser fertility rules keep."""
    return fertility.quality_rules(docs).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near duplicates (five words, 0.8)."""
    return ngram_join.keep_first(docs, n=5, percent=80).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontam.find_contamination(docs, load(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs.select("doc_id", "text"), keep=("doc_id",), digests=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", encoding_stage),
]

#: No stage before the last can be written in SQL (a learned model, tokenisers).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every result but the last is written to the shared
    checkpoint folder and reread."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared_table(docs, f"pipeline-{name}")
    return docs
