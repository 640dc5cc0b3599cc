"""From raw documents to packed sequences: language, lines, near copies, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalake.llm.common import load, stored
from quantalake.llm.decontam import decontaminate
from quantalake.llm.langid import cuts, fit, judge, keep_known
from quantalake.llm.linedup import line_dedup
from quantalake.llm.neardup import near_duplicates
from quantalake.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go: no text, no letter, or too few of the n-grams of every language."""
    filters = fit(docs)
    docs = stored(judge(docs, filters), "judged")
    return keep_known(docs, filters, cuts(docs, filters)).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; every document stays, with what is left of its text."""
    kept = line_dedup(docs, out_col="text")
    return kept.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    return near_duplicates(docs).where("kept").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover most of a benchmark item go."""
    return decontaminate(docs, load(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Language identification, tiling and tokenizers can't be expressed in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
