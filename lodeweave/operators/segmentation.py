"""Segmentation of ordered layout blocks into numbered records.

A paper's blocks are one bounded group; what depends on all of them in order
(the best chain of numbers, regions that flow over columns and pages) runs per
paper, everything before and after it is column code.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exam
from .sequences import chains, ordered_groups
from .taxonomy import settled

_START = re.compile(r"^\s*(\d{1,3})\s*[.)]\s*(.*)", re.S)
_QUESTION = re.compile(r"^(What|Which|How|Find|Show|Let|Given|If)\b")
_POINTS = re.compile(r"\(\d+ points?\)")
REGIONS = "array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>"


def candidate_score(text: str) -> tuple[int, float] | None:
    """Number and score of a line that begins like a question."""
    m = _START.match(text)
    if not m:
        return None
    number, rest = int(m[1]), m[2]
    if number == 0:
        return 0, 0.2
    return number, 3.0 + bool(_QUESTION.match(rest)) + 1.5 * bool(_POINTS.search(rest)) - 1.5 * bool(re.match(r"[=+*/<>-]", rest))


def segment(blocks: DataFrame) -> DataFrame:
    """Records of every paper of ``blocks`` (those of :mod:`.exam`): (paper_id, number, first_seq, section, text, regions).

    Columns, starts and gaps by :func:`.exam.analyse`, a lost first number where
    the evidence is strong, then texts and boxes up to the next start or heading.
    """
    layout = exam.with_leading(blocks, exam.analyse(blocks))
    layout = layout._replace(starts=settled(layout.starts))
    boxes = exam.regions(layout).groupBy("paper_id", "number", F.col("seq").alias("first_seq")).agg(F.array_sort(F.collect_list(F.struct("slot", "page", "x0", "y0", "x1", "y1"))).alias("regions"))
    texts = exam.questions(blocks, layout).withColumnRenamed("seq", "first_seq")
    # both are dealt out by paper already, and a join by paper keeps them there
    start = F.struct("number", "first_seq")
    of_paper = boxes.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct(start, "regions"))).alias("boxes"))
    texts = texts.join(of_paper, "paper_id", "left").withColumn("regions", F.try_element_at("boxes", start))
    return texts.select("paper_id", "number", "first_seq", "section", "text", F.coalesce(F.transform("regions", lambda r: F.struct(r["page"].alias("page"), r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1"))), F.array().cast(REGIONS)).alias("regions"))


def _scopes(blocks: list) -> list[tuple]:
    scope, last, out, heading = 0, 0, [], ""
    for b in blocks:
        text = b.text or ""
        if text.lstrip().startswith("#"):
            scope, last, heading = scope + 1, 0, text.strip("# \n")
        elif (s := candidate_score(text)) and s[0]:
            scope += s[0] <= last
            last = s[0]
            out.append((b.paper_id, b.seq, s[0], scope, heading))
    return out


def book_scopes(blocks: DataFrame) -> DataFrame:
    """Numbering scopes of a book: a heading line or a number that falls back opens one."""
    return ordered_groups(blocks, "paper_id", ["seq"], _scopes, "paper_id long, seq int, number int, scope int, heading string")


def draft_text(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Text of each record from the blocks whose centre lies in its regions, in reading order."""
    cx, cy = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    inside = cx.between(F.col("r.x0"), F.col("r.x1")) & cy.between(F.col("r.y0"), F.col("r.y1"))
    hit = regions.alias("r").join(blocks.alias("b"), (F.col("r.paper_id") == F.col("b.paper_id")) & (F.col("r.page") == F.col("b.page")) & inside)
    ordered = F.array_sort(F.collect_set(F.struct(F.col("b.page"), F.col("b.y0"), F.col("b.x0"), F.col("b.seq"), F.col("b.text"))))
    return hit.groupBy(F.col("r.paper_id"), F.col("r.number")).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


# Score and distance of sure starts that are read twice, highest number that begins
# a numbering, and how far a numbering may go on behind a stray number.
SURE, REREAD, OPENING, ONWARD = 3.0, 60.0, 3, 3


def _numberings(starts: list) -> list[tuple]:
    """A paper's starts with the run of numbers they belong to; re-read lines and strays inside a run are left out."""
    lines: list = []
    for s in starts:
        spot = (s.number, s.page, s.column)
        if not lines or spot != (lines[-1].number, lines[-1].page, lines[-1].column) or abs(s.y - lines[-1].y) >= REREAD:
            lines.append(s)
    out, run, taken, top = [], 0, set(), 0
    for place, s in enumerate(lines):
        if s.number <= top and (s.number <= OPENING or s.number in taken):
            goes_on = place + 1 < len(lines) and 0 < lines[place + 1].number - top <= ONWARD
            if goes_on:
                continue
            run, taken, top = run + 1, set(), 0
        taken.add(s.number)
        top = max(top, s.number)
        out.append((s.paper_id, run, place, s.seq, s.page, s.number))
    return out


def numbering_scopes(pages: DataFrame, starts: DataFrame, repaired: DataFrame | None = None) -> DataFrame:
    """Scopes of a paper in which numbers rise, each from where they begin anew.

    ``pages(paper_id, page)`` are all pages, ``starts(paper_id, seq, page,
    column, y, number, score, at_start)`` the candidates, ``repaired(paper_id,
    seq)`` those that gap repair has read otherwise. Sure starts count; a paper
    without any is read by its best chain. A lone number too high to begin a
    numbering belongs to the run before it. The first scope begins with the
    paper; a page is shared by two scopes only if the later begins on the page
    where the earlier ends.
    """
    found = starts.where("number > 0")
    sure = found.where(F.col("at_start") & (F.col("score") >= SURE))
    if repaired is not None:
        sure = sure.join(repaired.select("paper_id", "seq"), ["paper_id", "seq"], "left_anti")
    unsure = found.join(sure.select("paper_id").distinct(), "paper_id", "left_anti")
    used = sure.unionByName(unsure.join(chains(unsure).select("paper_id", "seq", "number"), ["paper_id", "seq", "number"], "left_semi"))
    rows = ordered_groups(used.select("paper_id", "seq", "page", "column", "y", "number"), "paper_id", ["page", "column", "y", "seq"], _numberings, "paper_id long, run int, place int, seq int, page int, number int")
    head, tail = F.struct("place", "seq", "page", "number"), F.struct("place", "page")
    runs = rows.groupBy("paper_id", "run").agg(F.min(head).alias("head"), F.max(tail).alias("tail"), F.count("*").alias("n"))
    by = Window.partitionBy("paper_id").orderBy("run")
    opens = (F.col("run") == 0) | (F.col("n") > 1) | (F.col("head.number") <= OPENING)
    runs = runs.withColumn("scope", F.sum(opens.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - 1)
    scopes = runs.groupBy("paper_id", "scope").agg(F.min("head").alias("head"), F.max("tail").alias("tail"))
    after, first = F.lead("head").over(Window.partitionBy("paper_id").orderBy("scope")), F.col("scope") == 0
    ends = scopes.withColumn("after", after).join(pages.groupBy("paper_id").agg(F.min("page").alias("from"), F.max("page").alias("to")), "paper_id")
    shared = F.col("after.page") == F.col("tail.page")
    return ends.select(
        "paper_id",
        "scope",
        F.col("head.number").alias("first_number"),
        F.when(first, F.col("from")).otherwise(F.col("head.page")).alias("first_page"),
        F.coalesce(F.when(shared, F.col("after.page")), F.col("after.page") - 1, F.col("to")).alias("last_page"),
        F.when(~first, F.col("head.seq")).alias("seq_start"),
        (F.col("after.seq") - 1).alias("seq_end"),
    )
