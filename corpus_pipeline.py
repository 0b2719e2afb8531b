"""A training corpus from raw documents: language, recurring lines, near duplicates, repeated passages, packing.

Every stage takes all that its predecessor kept, as written to Parquet and read again.

Null and empty texts: `language` drops them, since they have no letter; the other stages keep them, and `pack` gives each
a piece of its end id alone. Very long texts are read whole everywhere. Repeated rows and copies are near duplicates; ties go
to the smallest doc_id, and what rows that repeat a doc_id give is stated in each operator's module. Empty tables give no row.
All stages but the last return the columns they were given, further ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import langid, lines, neardup, packing, suffix
from sparkloom.llm.common import materialise, table
from sparkloom.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a clear language go; `lang` is what was found."""
    return langid.accepted(docs, tokenizer("piece_bpe_32k.model"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents stay in the first document alone."""
    return lines.without_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    kept = neardup.near_duplicates(docs, percent=80).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that start earlier in the corpus go."""
    return suffix.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer(), end_id=0)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("pack", pack)]

#: Language models, similarity joins and suffix arrays aren't expressible in SQL; tests/llm has brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
