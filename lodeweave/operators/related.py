"""Records that restate one another: equal fingerprints across documents, answers that don't contradict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 20


def folded(text: str) -> Column:
    """Prose folded for a looser match: case, punctuation and white space dropped."""
    return F.regexp_replace(F.lower(F.col(text)), r"[\s.,;:!?'\"()|-]", "")


def fingerprints(rows: DataFrame) -> DataFrame:
    """Exact and possible fingerprints of records that are eligible: a known kind, a stem, no image body."""
    fit = rows.where("kind is not null and stem <> '' and coalesce(body_mode, '') <> 'image'")
    return fit.withColumns({"exact": F.sha2(F.concat_ws("|", "kind", F.trim("stem")), 256), "possible": F.sha2(F.concat_ws("|", "kind", folded("stem")), 256)})


def related_sources(rows: DataFrame) -> DataFrame:
    """For each record others of the same kind and text from other questions and papers.

    Classes are ``exact`` and ``possible`` (only the looser fingerprint); pairs
    with two different answers are out; a question counts once; all are
    counted and the first ``MOST`` listed. The self-join is on the looser
    fingerprint, which the exact one implies.
    """
    prints = fingerprints(rows).where("status = 'published'").select("id", "question_id", "paper_id", "answer", "exact", "possible")
    other = prints.select(*[F.col(c).alias(f"o_{c}") for c in prints.columns])
    pairs = prints.join(other, (F.col("possible") == F.col("o_possible")) & (F.col("question_id") != F.col("o_question_id")) & (F.col("paper_id") != F.col("o_paper_id")))
    a, b = F.trim(F.coalesce("answer", F.lit(""))), F.trim(F.coalesce("o_answer", F.lit("")))
    pairs = pairs.where((a == "") | (b == "") | (a == b)).withColumn("class", F.when(F.col("exact") == F.col("o_exact"), "exact").otherwise("possible"))
    one = pairs.groupBy("id", "class", "o_question_id").agg(F.max("o_id").alias("other"))
    by = Window.partitionBy("id", "class")
    return one.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("other"))), "total": F.count("*").over(by)}).where(F.col("rank") <= MOST).select("id", "class", "other", "rank", "total", (F.col("total") > MOST).alias("truncated"))
