"""A cleaning pipeline over documents: language ID, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, language_id, line_dedup, packing, simhash
from tidelog.llm.common import read, written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: without a letter, or farther from all that is known than nearly
    all that was learned. The model is learned from the table of documents; lang is not used to predict."""
    names = docs.columns
    return language_id.identify(docs, read(spark, sf_dir, "documents")).where(~F.col("language.rejected")).select(*names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut out and n_chars counted anew; a document that loses all its lines goes."""
    names = docs.columns
    kept = line_dedup.line_dedup(docs).where((F.col("lines_deleted") == 0) | (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(*names)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the least id stays, rows without an id being last.

    Blank texts are a component like any other. Rows that share an id are told apart by their texts; of rows that repeat
    both, one stays.
    """
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    names = docs.columns
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).where("leaks.n_hit = 0").select(*names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document goes: doc_id, piece, bin_id, bin_offset, start, n_words."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


#: Fingerprints and models can't be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
