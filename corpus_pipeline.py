"""Corpus preparation in five stages: filter, cut repeated passages, drop near copies, mix, pack.

Every stage works on all that its predecessor kept and but for the last returns the columns of
``documents``. Stages are written as Parquet and read again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm.common import read_table
from tradelens.llm.lines import line_dedup
from tradelens.llm.mixing import mix_sources
from tradelens.llm.packing import pack
from tradelens.llm.quality import passing
from tradelens.llm.simhash import keep_one
from tradelens.sources.shared import remove_folder, shared_folder


def _documents(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null and empty texts have no words and are rejected; repeated rows are judged alike."""
    return passing(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated passages go from the texts; ``n_chars`` follows.

    Null and empty texts and rows without a doc_id stay as they are; repeated rows are cut alike, and texts that share a doc_id
    each lose only what repeats in them.
    """
    done = line_dedup(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("n_cut_lines") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return _documents(done, docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the least doc_id.

    Texts without words are copies of each other, rows without a doc_id stay, and of equal rows one stays.
    """
    return _documents(keep_one(docs), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to the target mixture; every document stays at least once.

    A null source is a source of its own; texts without words have no tokens and are repeated with their source.
    """
    return _documents(mix_sources(docs), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; a null or empty text is its end token alone."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_copy_stage),
    ("temperature_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SimHash and tokenization have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again.

    A stage's folder goes when the next one is written; the last of them stays, as the result reads it. An empty table
    gives an empty result, and further columns of any name pass through all stages but the last.
    """
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if k:
                remove_folder(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs
