"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Each stage takes what the one before kept, written as Parquet and read again; all but the last return the columns of
documents. Verdicts belong to rows: rows that repeat an id, or have none, are judged each on its own, but for line
dedup, where rows without an id keep all lines, and mixing, where documents of one id share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table, unused
from lodestone.llm.decontaminate import without_benchmark
from lodestone.llm.language_id import train_languages, with_language
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.mixing import fit, sample
from lodestone.llm.ngram_join import first_of_groups
from lodestone.llm.queries import TARGETS


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter go."""
    name = unused(docs, "language")
    return with_language(docs, train_languages(docs), name).where(F.col(name) != "und").drop(name)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand, exactly or nearly, earlier in the corpus; documents that have nothing else go."""
    return dedup_lines(docs, min_chars=1)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest id: five words, a similarity of 0.8 or more."""
    return first_of_groups(docs, percent=80, width=5)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's passage."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked mixture samples."""
    return sample(docs, fit(docs, TARGETS))


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("ngram_join", near_copies),
    ("decontaminate", benchmarks),
    ("mixing", mixture),
]

#: SQL can't express these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
