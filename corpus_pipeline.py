"""Corpus pipeline: documents -> packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of ``documents``; the last returns one row for each packed
piece (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

In every stage a null text counts as the empty text, rows with a null doc_id and
repeated rows stay rows of their own, texts are read whole, an empty table gives
an empty one, and other columns are carried (the last stage drops them).  The
operators' modules say what each does with ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demoforge.llm import exact_dedup, packing, quality, simhash, suffix_repeats
from demoforge.llm.common import Workspace
from demoforge.llm.encode import default_tokenizer
from demoforge.session import read_table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grade model does not reject."""
    return quality.select_quality(docs, read_table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (the largest doc_id)."""
    return exact_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (the smallest doc_id)."""
    return simhash.near_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat."""
    return suffix_repeats.remove(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in the training sequences."""
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", packed),
]

#: a trained filter and a tokeniser have no SQL form; tests hold each stage
#: against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
