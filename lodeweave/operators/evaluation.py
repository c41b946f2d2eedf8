"""Scores of a segmentation against annotations: identity, coverage, figures."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .sequences import ordered_groups
from .spatial import covered, covered_by_both

KEYS = ["doc_id", "group_no", "kind", "number"]


def identity(truth: DataFrame, result: DataFrame) -> DataFrame:
    """Per document: matched, missed and extra records; of repeated predictions the first counts, others are extra."""
    first = Window.partitionBy(*KEYS).orderBy("position")
    named = result.withColumn("_r", F.row_number().over(first))
    hit = named.where("_r = 1").select(*[F.col(k).alias(f"_{k}") for k in KEYS], F.lit(1).alias("_p"))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS])
    both = truth.select(*KEYS, F.lit(1).alias("_t")).join(hit, on, "full_outer").select(F.coalesce("doc_id", "_doc_id").alias("doc_id"), "_t", "_p")
    sums = both.groupBy("doc_id").agg(F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("matched"), F.count_if(F.col("_p").isNull()).alias("missed"), F.count_if(F.col("_t").isNull()).alias("extra"))
    more = named.where("_r > 1").groupBy("doc_id").agg(F.count("*").alias("_more"))
    out = sums.join(more, "doc_id", "left").withColumn("extra", F.col("extra") + F.coalesce("_more", F.lit(0))).drop("_more")
    ratio = lambda a, b: F.when(b != 0, a / b)
    return out.withColumns({"precision": ratio(F.col("matched"), F.col("matched") + F.col("extra")), "recall": ratio(F.col("matched"), F.col("matched") + F.col("missed"))})


def iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def most_matches(edges: dict[int, list[int]]) -> int:
    """Size of a maximum one-to-one matching, by augmenting paths."""
    owner: dict[int, int] = {}

    def place(u: int, seen: set[int]) -> bool:
        for v in edges[u]:
            if v not in seen:
                seen.add(v)
                if v not in owner or place(owner[v], seen):
                    owner[v] = u
                    return True
        return False

    return sum(place(u, set()) for u in sorted(edges))


def figure_matches(candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """Most figures of each document matched one to one among candidate pairs ``(doc_id, truth, result, iou)``."""

    def run(rows: list) -> list[tuple]:
        edges: dict[int, list[int]] = {}
        for r in rows:
            edges.setdefault(r.truth, []).extend([r.result] if r.iou >= least else [])
        return [(rows[0].doc_id, most_matches(edges))]

    return ordered_groups(candidates, "doc_id", ["truth", "result"], run, "doc_id long, matched int")


@F.pandas_udf(LongType())
def _most_matched(ends: pd.Series, others: pd.Series) -> pd.Series:
    """Size of a maximum one-to-one matching of each row's pairs; null for none."""

    def most(a, b) -> int | None:
        if a is None:
            return None
        edges: dict[int, list[int]] = {}
        for u, v in zip(a, b):
            edges.setdefault(int(u), []).append(int(v))
        return most_matches(edges)

    return pd.Series([most(a, b) for a, b in zip(ends, others)], dtype="Int64")


BOX = ["x0", "y0", "x1", "y1"]


def _boxes(parts: Column) -> Column:
    """The boxes of an array that have a page and a size."""
    box = lambda b: F.struct(b["page"].alias("page"), *[b[c].cast("double").alias(c) for c in BOX])
    return F.filter(F.transform(parts, box), lambda b: b["page"].isNotNull() & (b["x0"] < b["x1"]) & (b["y0"] < b["y1"]))


def _shapes(figures: Column) -> Column:
    """An array's figures by id and slot: (figure, slot, pages, boxes, area)."""
    ids = F.array_distinct(F.transform(figures, lambda f: F.struct(f["figure"].alias("figure"), f["slot"].alias("slot"))))
    parts = F.transform(ids, lambda i: F.filter(figures, lambda f: (f["figure"] == i["figure"]) & (f["slot"] == i["slot"])))
    parts = F.filter(parts, lambda p: F.size(p) > 0)  # of none without an id or slot
    one = lambda p, c: F.get(p, F.lit(0))[c].alias(c)
    pages = lambda p: F.array_sort(F.array_distinct(F.array_compact(F.transform(p, lambda f: f["page"]))))
    shapes = F.transform(parts, lambda p: F.struct(one(p, "figure"), one(p, "slot"), pages(p).alias("pages"), _boxes(p).alias("boxes")))
    return F.transform(shapes, lambda s: F.struct(s["figure"], s["slot"], s["pages"], s["boxes"], covered(s["boxes"]).alias("area")))


def _alike(truth: Column, result: Column, least: float) -> Column:
    """Pairs (t, r) of figures of two arrays of shapes with equal slots and pages and an intersection over union of ``least``."""
    enough = lambda a, b, both: F.when(both > 0, both / (a["area"] + b["area"] - both) >= least).otherwise(False)
    same = lambda a, b: F.when((a["slot"] == b["slot"]) & (a["pages"] == b["pages"]), F.exists(F.array(covered_by_both(a["boxes"], b["boxes"])), lambda both: enough(a, b, both))).otherwise(False)
    pairs = F.transform(truth, lambda a: F.transform(F.filter(result, lambda b: same(a, b)), lambda b: F.struct(a["figure"].alias("t"), b["figure"].alias("r"))))
    return F.array_distinct(F.flatten(pairs))


def card_scores(cards: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of :func:`layout_scores` from nested cards of both sides.

    ``cards(doc_id, side, card, names, regions, figures)`` has a row for each
    card, ``names`` the ``(group_no, kind, number)`` under which it is listed,
    ``regions`` the ``(page, x0, y0, x1, y1)`` and ``figures`` the ``(figure,
    slot, page, x0, y0, x1, y1)`` of its boxes. Cards that are dealt by document
    cross no network any more: all that follows is grouped by it.
    """
    ids = F.array_distinct(F.transform("figures", lambda f: f["figure"]))
    each = cards.select("doc_id", "side", "card", "names", _boxes(F.col("regions")).alias("boxes"), "figures", F.size(ids).alias("n"))
    each = each.select("doc_id", "side", "card", "boxes", "figures", "n", covered(F.col("boxes")).alias("area"), F.posexplode_outer("names").alias("k", "name"))
    truth, result, once, listed = F.col("side") == "truth", F.col("side") == "result", F.coalesce("k", F.lit(0)) == 0, F.col("k").isNotNull()
    inside = F.struct("boxes", "figures")
    total = lambda which, what: F.sum(F.when(which & once, F.col(what)))
    groups = each.groupBy("doc_id", *[F.col(f"name.{c}").alias(c) for c in KEYS[1:]]).agg(
        F.count_if(truth & listed).alias("truth_cards"), F.count_if(result & listed).alias("result_cards"), total(truth, "area").alias("truth_area"), total(result, "area").alias("result_area"), total(truth, "n").alias("truth_figures"), total(result, "n").alias("result_figures"),
        F.collect_list(F.when(truth & listed, inside)).alias("truths"), F.min_by(F.when(result & listed, inside), F.when(result & listed, F.col("card"))).alias("first"),
    )
    found = F.col("first").isNotNull()
    sums = ["truth_cards", "result_cards", "matched_cards", "truth_area", "result_area", "truth_figures", "result_figures"]
    groups = groups.withColumn("matched_cards", F.when(found, F.col("truth_cards")).otherwise(0))
    pairs = groups.select("doc_id", *sums, "first", F.posexplode_outer(F.when(found, F.col("truths"))).alias("k", "t"))
    pairs = pairs.select("doc_id", *[F.when(F.coalesce("k", F.lit(0)) == 0, F.col(c)).alias(c) for c in sums], F.col("t.boxes").alias("t_boxes"), F.col("first.boxes").alias("r_boxes"), *[F.when(F.col("k").isNotNull(), _shapes(F.col(f"{side}.figures"))).alias(name) for side, name in (("t", "t_shapes"), ("first", "r_shapes"))])
    pairs = pairs.select("doc_id", *sums, covered_by_both(F.col("t_boxes"), F.col("r_boxes")).alias("shared_area"), _alike(F.col("t_shapes"), F.col("r_shapes"), least).alias("alike"))
    # pairs without a common end are a matching; others are matched in Python
    ends = lambda c: F.transform("alike", lambda e: e[c])
    free = (F.size(F.array_distinct(ends("t"))) == F.size("alike")) & (F.size(F.array_distinct(ends("r"))) == F.size("alike"))
    places = lambda c: F.when(~free, F.transform(ends(c), lambda x: F.array_position(F.array_distinct(ends(c)), x)))
    pairs = pairs.select("doc_id", *sums, "shared_area", F.when(free, F.size("alike")).alias("pairs"), places("t").alias("ends"), places("r").alias("others"))
    pairs = pairs.withColumn("matched_figures", F.coalesce("pairs", _most_matched("ends", "others")))
    counts = ["truth_cards", "result_cards", "matched_cards", "truth_area", "result_area", "shared_area", "truth_figures", "result_figures", "matched_figures"]
    out = pairs.groupBy("doc_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts]).where("truth_cards + result_cards > 0")
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return out.withColumns({
        "precision": ratio("matched_cards", "result_cards"), "recall": ratio("matched_cards", "truth_cards"), "area_coverage": ratio("shared_area", "truth_area"), "area_precision": ratio("shared_area", "result_area"),
        "figure_precision": ratio("matched_figures", "result_figures"), "figure_recall": ratio("matched_figures", "truth_figures"),
    })


def layout_scores(truth: DataFrame, result: DataFrame, regions: DataFrame, figures: DataFrame, least: float = 0.5) -> DataFrame:
    """A row per document: questions found, area of their regions covered, figures matched.

    ``truth`` and ``result(doc_id, card, group_no, kind, number)`` list the cards
    of annotations and of a segmentation, in order of ``card``; of repeated
    questions of a result the first counts. ``regions(doc_id, side, card, page,
    x0, y0, x1, y1)`` and ``figures(doc_id, side, card, figure, slot, page, x0,
    y0, x1, y1)`` hold the boxes of both sides. Figures match one to one within
    matched cards, with equal slots and pages and an intersection over union of
    ``least``, as many as can. Areas are unions over pages. A ratio without a
    denominator is null; documents of one side only have a row too. All four
    tables are dealt out by document once.
    """
    name, region, figure = F.struct(*KEYS[1:]).alias("name"), F.struct("page", *BOX).alias("region"), F.struct("figure", "slot", "page", *BOX).alias("figure")
    card = lambda df, side: df.select("doc_id", F.lit(side).alias("side"), "card", name)
    rows = card(truth, "truth").unionByName(card(result, "result")).unionByName(regions.select("doc_id", "side", "card", region), True).unionByName(figures.select("doc_id", "side", "card", figure), True)
    nested = rows.repartition("doc_id").groupBy("doc_id", "side", "card").agg(F.collect_list("name").alias("names"), F.collect_list("region").alias("regions"), F.collect_list("figure").alias("figures"))
    return card_scores(nested, least)
