"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm import (bpe, common, decontam, fertility, fim, html_density, langid,
                       license_scan, ngram_join, packed_ids, periodic, pu_quality,
                       substring_dedup, url_trie)

load = common.load

#: Rules of the url filter: (verdict, host and path).
URL_RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
    ("allow", "com/fr/"), ("block", "com/de/"),
)


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return fertility.quality_rules(docs, keep=("doc_id",))


def op2_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trie.filter_urls(load(spark, sf_dir, "pages", "page_id", "url"), URL_RULES,
                                keep=("page_id",))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.encode_documents(docs, keep=("doc_id",), digests=True)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    return license_scan.scan_licenses(docs).drop("spans")


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    files = packed_ids.write_ids(docs, packed_ids.fresh_folder(spark))
    return packed_ids.read_ids(files, whole=False).withColumnRenamed("key", "doc_id")


def op6_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    held = common.crc_bucket("doc_id", 3) == 1
    model = pu_quality.fit(docs, load(spark, sf_dir, "labels", "doc_id", "quality"), ~held)
    return pu_quality.score_quality(docs, model, keep=("doc_id",)).select(
        "doc_id", held.alias("held_out"), "score", "predicted")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(load(spark, sf_dir, "documents", "doc_id", "text"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = common.crc_bucket("doc_id", 5) == 0
    model = langid.fit(docs, ~held)
    return langid.predict(docs, model, keep=("doc_id",)).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    found = decontam.find_contamination(docs, load(spark, sf_dir, "benchmark", "item_id", "text"),
                                        keep=("doc_id",))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        decontam.items_digest().alias("items_sha256"), "contaminated")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_density.extract_main_text(pages, keep=("page_id", "url"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    out = substring_dedup.remove_repeats(docs, keep=("doc_id",))
    return out.select("doc_id", "n_words", "n_removed",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    out = fim.fill_in_middle(docs, keep=("doc_id",))
    digest = [F.sha2(c.cast("binary"), 256) for c in (F.col("output"), fim.restored())]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      digest[0].alias("output_sha256"), digest[1].alias("restored_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.repeat_tail(load(spark, sf_dir, "documents", "doc_id", "text"))
    found = periodic.find_runs(docs, keep=("doc_id",)).withColumn("best", periodic.most_periodic())
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length",
        "best.period", F.floor(F.expr("best.length * 1000 div best.period")).alias("exponent_milli"),
        periodic.run_digest().alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_fertility, op2_url_trie, op3_bpe, op4_license_scan,
        op5_packed_ids, op6_pu_quality, op7_ngram_jaccard, op8_language_id, op9_decontaminate,
        op10_main_text, op11_substring_dedup, op12_fill_in_middle, op13_periodic_runs)
}
