"""A training-data pipeline over ``documents``; each stage is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.llm import bpe, decontam, linededup, neardup, toxicity
from reefline.llm.common import folder, remove, table, written
from reefline.llm.queries import digests, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with ``n_chars`` of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a machine trained on all labels does not call toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("score < 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that three documents share."""
    return _documents(linededup.drop_common_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.near_duplicates(docs).filter("kept").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return digests(bpe.encode(docs, vocabulary()))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what its predecessor kept."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        where = folder(spark, name.split()[0])
        docs = written(stage(spark, docs, sf_dir), where)
        if before:  # nothing reads the stage before the last one any more
            remove(spark, before)
        before = where
    return STAGES[-1][1](spark, docs, sf_dir)
