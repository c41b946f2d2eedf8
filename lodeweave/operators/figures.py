"""Ownership of figures: rows handed out, captions, claims, candidates to repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_distribution(figures: DataFrame, questions: DataFrame) -> DataFrame:
    """Hands a row of side-by-side figures to consecutive questions, left to right.

    A row is a page's figures that meet vertically by half of the shorter and
    hardly meet horizontally, neighbour by neighbour; the run of questions has
    cues and ends or begins at the figures' owner. Rows of one figure stay.
    """
    by = Window.partitionBy("paper_id", "page").orderBy("x0", "seq")
    prev = lambda c: F.lag(c).over(by)
    meet = F.least("y1", prev("y1")) - F.greatest("y0", prev("y0"))
    shorter = F.least(F.col("y1") - F.col("y0"), prev("y1") - prev("y0"))
    joined = (meet >= 0.5 * shorter) & (F.col("x0") >= prev("x1") - 4)
    rows = figures.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("row", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    placed = rows.withColumns({"rank": F.row_number().over(Window.partitionBy("paper_id", "page", "row").orderBy("x0", "seq")), "size": F.count("*").over(Window.partitionBy("paper_id", "page", "row"))}).where("size > 1")
    owner = placed.groupBy("paper_id", "page", "row").agg(F.min("owner").alias("first"))
    cued = questions.where("cue").select("paper_id", F.col("number").alias("to"))
    given = placed.join(owner, ["paper_id", "page", "row"]).withColumn("to", F.col("first") + F.col("rank") - 1)
    return given.join(cued, ["paper_id", "to"], "left").select("paper_id", "page", "seq", "row", "to")


def caption_owners(figures: DataFrame, questions: DataFrame) -> DataFrame:
    """Figures whose caption names a question: that question owns them."""
    named = figures.withColumn("number", F.regexp_extract("caption", r"(?i)for (?:question|no\.?)\s*(\d+)", 1).try_cast("int"))
    return named.where("number is not null").join(questions.select("paper_id", "number", "question_id"), ["paper_id", "number"])


def shared_captions(figures: DataFrame, questions: DataFrame) -> DataFrame:
    """Figures that a caption shares among questions n to m: one row a question."""
    low, high = (F.regexp_extract("caption", r"(?i)questions?\s*(\d+)\s*(?:-|to)\s*(\d+)", k).try_cast("int") for k in (1, 2))
    ranged = figures.withColumns({"lo": low, "hi": high}).where("lo is not null and hi >= lo")
    asked = questions.select("paper_id", "number", "question_id")
    return ranged.join(asked, "paper_id").where(F.col("number").between(F.col("lo"), F.col("hi"))).select("figure_id", "question_id")


def lost_candidates(candidates: DataFrame, owned: DataFrame, regions: DataFrame) -> DataFrame:
    """Candidates that no record owns though they lie in its region: what a repair would add."""
    from .spatial import figures_in_regions

    free = candidates.join(owned, ["paper_id", "seq"], "left_anti")
    inside = figures_in_regions(free, regions)
    return inside.where("inside").select("paper_id", "page", "seq")


def ambiguous_labels(labels: DataFrame, images: DataFrame, margin: float = 12) -> DataFrame:
    """Each option label's nearest image below it, unless a second one is nearer than the margin."""
    pair = labels.select("paper_id", "page", "letter", F.col("x").alias("lx"), F.col("y").alias("ly")).join(images, ["paper_id", "page"])
    gap = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("lx")) + F.abs(F.col("y0") - F.col("ly"))
    by = Window.partitionBy("paper_id", "page", "letter").orderBy("_g", "seq")
    ranked = pair.withColumn("_g", gap).withColumns({"_r": F.row_number().over(by), "_next": F.lead("_g").over(by)}).where("_r = 1")
    return ranked.select("paper_id", "page", "letter", F.when(F.col("_next").isNull() | (F.col("_next") - F.col("_g") >= margin), F.col("seq")).alias("seq"))


def parts_cap(parts: Column, most: int = 4) -> Column:
    return F.slice(parts, 1, most)
