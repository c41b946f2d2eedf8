"""Ways into a collection that need no file parsing here: photo sets, a sibling collection's parsed papers, a curriculum template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Longest side of a page image in pixels, and dots per inch that give its size on paper.
LONG_SIDE, DPI = 3000, 200


def photo_pages(photos: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """``(set_id, page, selected, file, width, height, width_pt, height_pt)`` of photo sets.

    ``photos(set_id, selected, place, width, height)`` have a place each, as
    ``ordering.natural_order`` gives; ``orders(set_id, selected, place)``
    replaces the places of the sets it names, and what it leaves out of them
    is no page. A photo keeps the file of its selection, whatever its page.
    """
    placed = photos.select("set_id", "selected", "place", "width", "height")
    if orders is not None:
        told = placed.drop("place").join(orders.select("set_id", "selected", "place"), ["set_id", "selected"])
        placed = placed.join(orders.select("set_id").distinct(), "set_id", "left_anti").unionByName(told)
    most = F.greatest("width", "height")
    side = lambda c: F.when(most > LONG_SIDE, F.greatest(F.lit(1), F.round(F.col(c) * LONG_SIDE / most))).otherwise(F.col(c)).cast("int")
    point = lambda c: F.round(F.col(c) * 72 / DPI, 2)
    page = F.row_number().over(Window.partitionBy("set_id").orderBy("place", "selected"))
    file = F.format_string("photo_%02d.page.jpg", F.col("selected") + 1)
    sized = placed.select("set_id", page.alias("page"), "selected", file.alias("file"), side("width").alias("width"), side("height").alias("height"))
    return sized.withColumns({"width_pt": point("width"), "height_pt": point("height")})


def import_parsed(papers: DataFrame, sibling: DataFrame, wanted: DataFrame, content: Column) -> DataFrame:
    """What importing the ``wanted(id)`` papers of a sibling collection gives: ``(id, paper_id, filename, kind, sha256, state)``.

    ``sibling(id, filename, kind, ...)`` has the parsed papers, ``content`` is
    the source's bytes. A paper that was imported before is ``known`` and keeps
    its row of ``papers(paper_id, imported_from)``, the one with the smallest
    id; an id that the sibling lacks is ``missing``; the rest is ``new``.
    """
    before = papers.where("imported_from is not null").groupBy(F.col("imported_from").alias("id")).agg(F.min("paper_id").alias("paper_id"))
    there = sibling.select("id", "filename", "kind", F.sha2(content, 256).alias("sha256"), F.lit(True).alias("found"))
    asked = wanted.select("id").distinct().join(there, "id", "left").join(before, "id", "left")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("paper_id").isNotNull(), "known").otherwise("new")
    return asked.select("id", F.when(F.col("found"), F.col("paper_id")).alias("paper_id"), "filename", "kind", "sha256", state.alias("state"))


#: A small curriculum: each line is a topic, indented below what contains it.
TEMPLATE = """
Numbers
  Whole numbers
    Place value
    Divisibility
  Fractions
    Common denominators
Geometry
  Plane figures
    Triangles
    Circles
  Solids
Data
  Averages
  Charts
"""


def template_lines(spark, text: str = TEMPLATE) -> DataFrame:
    """A template's lines as ``outline`` takes them; blank lines are none."""
    lines = [(0, k, line) for k, line in enumerate(x for x in text.splitlines() if x.strip())]
    return spark.createDataFrame(lines, "doc_id int, pos int, line string")
