"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import table
from stratalog.llm.oracles import ORACLES  # noqa: F401


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url")).drop("url")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.quality_rules import judge_quality

    return judge_quality(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.decontaminate import decontaminate

    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate(docs, items, clean=False)
    names = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.ngram_join import linked_components

    return linked_components(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.lm_score import score

    return score(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))[0]


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.suffix_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratalog.llm.language_id import fold, train_and_identify

    judged = train_and_identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return judged.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontaminate": op3_decontaminate,
    "op4_ngram_join": op4_ngram_join,
    "op5_html_extract": op5_html_extract,
    "op6_lm_score": op6_lm_score,
    "op7_mix_sources": op7_mix_sources,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language_id": op10_language_id,
}
