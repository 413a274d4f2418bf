"""A training corpus from documents: language ID, line dedup, near-dedup, decontamination, mix.

Every stage works on all rows its predecessor kept, is written as Parquet and read again.
All but the last return the columns of documents; the last returns the mix.

Defined results: a null or empty text, or one without letters, is rejected by the language
stage; a document that line dedup leaves without a word goes; a near copy goes whatever
line dedup has left of it; rows that repeat a doc_id and its text become one in near-dedup;
a null doc_id shares nothing with other rows and stays; an empty table gives an empty mix;
texts of any length are read whole; further columns are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellgauge.llm.decontaminate import uncontaminated
from cellgauge.llm.language import known_language
from cellgauge.llm.line_dedup import cleaned
from cellgauge.llm.minhash import without_copies
from cellgauge.llm.mixing import mix_sources
from cellgauge.llm.scratch import Scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no learned language can be told."""
    return known_language(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document stays with what is left of its text, if a word is."""
    return cleaned(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; similar is 0.8 or more of five-word sets, of whole texts or of what is left."""
    return without_copies(docs, table(spark, sf_dir, "documents"), percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of what is left."""
    return mix_sources(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix),
]

ORACLE_SQL = None  # SQL can express neither the sketches nor the classifier; tests use brute force.


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}_{name}")
    return docs
