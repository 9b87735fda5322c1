"""From raw documents to token records, in five stages that each read what the one before has written."""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohesia.llm.common import saved, table, tuned
from cohesia.llm.minhash import deduplicated
from cohesia.llm.mixing import mixed
from cohesia.llm.quality import keep_good
from cohesia.llm.records import read_records, write_records
from cohesia.llm.templates import without_leaks

ORACLE_SQL = None  # trees, sketches, schedules and tokenizers have no SQL; tests compare with brute force
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_good(docs.select(COLUMNS), table(tuned(spark), sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies (five words, similarity 0.8)."""
    tuned(spark)
    return deduplicated(docs.select(COLUMNS), k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs.select(COLUMNS), table(tuned(spark), sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixing schedule: files and rows are in that order."""
    tuned(spark)
    return mixed(docs.select(COLUMNS))


def records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records in the order of the files and rows of docs (doc_id order if docs is not read from files)."""
    tuned(spark)
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
        ordered = docs.select("doc_id", "text", F.when(part != "", part).cast("long").alias("__file"), F.col("_metadata.file_name").alias("__name"), F.col("_metadata.row_index").alias("__row"))
        order = ["__file", "__name", "__row"]
    except AnalysisException:
        ordered, order = docs, ["doc_id"]
    base, _ = write_records(ordered, public_tokenizers.path("word_bpe_49k.json"), end_id=2, order=order)
    return read_records(spark, base)


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("mix", mix), ("records", records)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
