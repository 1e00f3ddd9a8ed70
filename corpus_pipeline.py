"""The training-corpus pipeline: language, near copies, benchmark text, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's rows to the shared folder and reads them again for the next.

Filters go by each row's own text, never by its id: rows with a null id, or with an id that other rows have
too, are judged like any others. All stages take an empty table (and return one), texts of any length whole,
and further columns of any name, which they pass on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candorlake.llm import decontam, langid, neardup, packing, secretscan
from candorlake.llm.common import discard, release, stored, table

#: Documents whose language is less likely than this are rejected; a guess among four scores 0.25. Short clean
#: texts of mixed words score about 0.4.
LEAST_LANGUAGE_SCORE = 0.3
#: Similarity of near copies, in percent.
NEAR_COPY_PERCENT = 80
#: SQL cannot express training a network or tokenizing; tests compare the stages with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null, empty and white ones among them) and those of no known language.

    The network learns from the documents that it is given; without any labelled one all are rejected. A text of
    any length counts as a whole. Of equally likely languages the first by name is taken.
    """
    release(spark)
    return langid.of_known_language(docs, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id.

    Documents that are equally similar to several groups join them. Null, empty and white texts are copies of
    nothing and stay; rows that repeat id and text are one document, rows that share an id only are not.
    """
    release(spark)
    return neardup.without_copies(docs, NEAR_COPY_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none, passages of a long text all
    count, and a score just at the threshold is a hit."""
    release(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts by their kind in brackets, whole texts of any length; drops nothing. Null texts
    stay null; of overlapping secrets the union is replaced once; n_chars follows the text."""
    release(spark)
    return secretscan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids: every row is a document, null and empty ones of the end
    id alone; repeated rows are packed as often as they come."""
    release(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        done, docs = docs, stored(stage(spark, docs, sf_dir))
        if number:
            discard(done)
    return STAGES[-1][1](spark, docs, sf_dir)
