"""A training corpus from ``documents``: five stages, each a table of its own.

Every stage works on all rows its predecessor kept and returns the columns of
``documents``, the last one the pieces of the packed sequences. Null texts,
empty texts, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import copies, lines, mixing, packing, toxicity
from lodeweave.llm.common import cut, drop_cut, scratch, table
from lodeweave.session import ready


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity reaches the threshold; all others stay, null and empty texts and rows without an id too."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def unboiler(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many sites share out of all documents but the first that has them.

    Every row stays, also with an empty text; null texts stay null; ``n_chars`` follows the text.
    """
    return lines.clean_lines(docs).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that share 0.8 or more of their five-word shingles.

    That with the smallest doc_id, null last; null and empty texts are copies of
    each other; unlike texts stay whatever their ids are.
    """
    return copies.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes sources at their target weights; a row that is taken twice stands twice.

    Null sources are one source, the last; null and empty texts have size 0.
    """
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all tokens into sequences; a null or empty text is one end id, rows that repeat are packed each."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("line_dedup", unboiler), ("near_dedup", dedup), ("mixing", mix), ("packing", pack)]

#: Near copies, learnt weights and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as kept:
            after = cut(stage(spark, docs, sf_dir))
            kept.append(after)
        drop_cut(docs)  # nothing reads the stage before any more
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
