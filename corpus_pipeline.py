"""Five stages that turn `documents` into a mix: each one's result is written as Parquet and read again as the next one's input.

Rejected by language ID: texts that are null or without a letter, or of which no language is likely enough.  Line dedup,
and decontamination for spans of test items, change `text` (and `n_chars`); a document of which more than half is test
items goes.  Of each group of linked documents the one with the least doc_id stays.  The last stage returns how many
words the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import drop_folder, new_folder, table
from stratalog.llm.decontaminate import decontaminate
from stratalog.llm.language_id import UNKNOWN, train_and_identify
from stratalog.llm.line_dedup import dedup_lines
from stratalog.llm.mixing import mix
from stratalog.llm.ngram_join import one_per_component

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = train_and_identify(docs.select(*COLUMNS))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _as_documents(dedup_lines(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_component(docs.select(*COLUMNS)).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return _as_documents(decontaminate(docs.select(*COLUMNS), items).where(~F.col("over_limit")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source"))[0]


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mixture),
]

#: Language ID, for one, has no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents", *COLUMNS), None
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            drop_folder(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
