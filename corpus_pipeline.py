"""A corpus from raw documents to packed sequences: five stages, each one operator of corpusmill.llm on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, langid, linededup, minhash, packing
from corpusmill.llm.common import discard, scratch, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near some language's centroids; null texts and texts without a letter go."""
    return langid.accepted(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are cut out of the texts, long single lines and whole short documents too; a document that has lost all
    its lines is a copy and goes.

    What goes is settled at the depth of the shortest run that counts; deeper intervals would only tell how long the copies are."""
    out = linededup.dedup_lines(docs, deepest=linededup.MIN_LINES, min_chars=linededup.MIN_CHARS).where("n_removed < n_lines or n_lines = 0")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their token ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packed)]

#: Language ID and MinHash are not SQL: the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            last, docs = docs, keep(stored(stage(spark, docs, sf_dir)))
        discard(last)
    out = packed(spark, docs, sf_dir)
    discard(docs)  # packing has stored their token ids
    return out
