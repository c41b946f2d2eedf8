"""Joins between boxes: equality on paper and page and a grid row, then exact predicates.

A page is cut into bands of ``BAND`` units; a box meets others only in the bands
it touches, and a pair is kept in the first band both touch, so it comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Height of a band; any height gives the same pairs.
BAND = 100


def valid(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    return (F.col(x1) > F.col(x0)) & (F.col(y1) > F.col(y0)) & (F.col(x0) >= 0) & (F.col(y0) >= 0)


def clamp(c: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.col(c)))


def candidate_key(*edges: str) -> Column:
    """Edges to one decimal, half away from zero, within 0..1000, without needless zeros, joined by commas."""
    one = lambda c: F.regexp_replace(F.round(clamp(c), 1).cast("decimal(6,1)").cast("string"), r"\.0$", "")
    return F.concat_ws(",", *[one(e) for e in edges])


def area(p: str = "") -> Column:
    return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))


def _renamed(boxes: DataFrame, p: str) -> DataFrame:
    return boxes.select("paper_id", "page", *[F.col(c).alias(p + c) for c in boxes.columns if c not in ("paper_id", "page")])


def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of boxes on a page whose vertical extents meet; columns get ``l_`` and ``r_``."""
    bands = lambda df, p: df.withColumn("_band", F.explode(F.sequence(F.floor(F.col(f"{p}y0") / BAND), F.floor(F.col(f"{p}y1") / BAND))))
    a, b = bands(_renamed(left, "l_"), "l_"), bands(_renamed(right, "r_"), "r_")
    first = F.greatest(F.floor(F.col("l_y0") / BAND), F.floor(F.col("r_y0") / BAND))
    return a.join(b, ["paper_id", "page", "_band"]).where(F.col("_band") == first).drop("_band")


def shared() -> Column:
    """Area that a pair has in common."""
    w = F.least("l_x1", "r_x1") - F.greatest("l_x0", "r_x0")
    h = F.least("l_y1", "r_y1") - F.greatest("l_y0", "r_y0")
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def overlaps(figures: DataFrame, regions: DataFrame, share: float = 0.2) -> DataFrame:
    """Figures of which a region has at least ``share``."""
    return pairs(figures, regions).where(shared() >= share * area("l_")).where(shared() > 0)


def overlaps_smaller(a: DataFrame, b: DataFrame, share: float = 0.6) -> DataFrame:
    """Pairs that share at least ``share`` of the smaller box."""
    return pairs(a, b).where(shared() >= share * F.least(area("l_"), area("r_"))).where(shared() > 0)


def figures_in_regions(figures: DataFrame, regions: DataFrame, share: float = 0.2) -> DataFrame:
    """Each figure: whether a region has its share of it and not all such regions lie wholly below its middle."""
    hit = overlaps(figures, regions, share)
    middle = (F.col("l_y0") + F.col("l_y1")) / 2
    return hit.groupBy("paper_id", "page", F.col("l_seq").alias("seq")).agg(F.count("*").alias("regions"), F.bool_or(middle >= F.col("r_y0")).alias("inside"))


def centers_in(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Boxes with their centre in a region: an equi join on the centre's band."""
    point = _renamed(boxes, "l_").withColumns({"_cx": (F.col("l_x0") + F.col("l_x1")) / 2, "_cy": (F.col("l_y0") + F.col("l_y1")) / 2}).withColumn("_band", F.floor(F.col("_cy") / BAND))
    area_ = _renamed(regions, "r_").withColumn("_band", F.explode(F.sequence(F.floor(F.col("r_y0") / BAND), F.floor(F.col("r_y1") / BAND))))
    inside = (F.col("_cx").between(F.col("r_x0"), F.col("r_x1"))) & F.col("_cy").between(F.col("r_y0"), F.col("r_y1"))
    return point.join(area_, ["paper_id", "page", "_band"]).where(inside).drop("_band")


def nearest(boxes: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` nearest targets of each box on its page by squared gap."""
    dx = F.greatest(F.lit(0.0), F.col("l_x0") - F.col("r_x1"), F.col("r_x0") - F.col("l_x1"))
    dy = F.greatest(F.lit(0.0), F.col("l_y0") - F.col("r_y1"), F.col("r_y0") - F.col("l_y1"))
    joined = _renamed(boxes, "l_").join(_renamed(targets, "r_"), ["paper_id", "page"]).withColumn("gap", dx * dx + dy * dy)
    best = Window.partitionBy("paper_id", "page", "l_seq").orderBy("gap", "r_seq")
    return joined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("paper_id", "page", F.col("l_seq").alias("seq"), F.col("r_seq").alias("target"), "gap", "rank")


def margins(boxes: DataFrame, gap: float = 120) -> DataFrame:
    """Clusters of left edges on a page: a new one starts after a gap."""
    by = Window.partitionBy("paper_id", "page").orderBy("x0", "seq")
    new = (F.col("x0") - F.lag("x0").over(by) > gap).cast("int")
    marked = boxes.withColumn("_n", F.coalesce(new, F.lit(0)))
    return marked.withColumn("cluster", F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("paper_id", "page", "cluster").agg(F.count("*").alias("boxes"), F.min("x0").alias("left"))


#: Where a page may be split, how far a box may reach over the line, how many may cross it.
SPLIT_FROM, SPLIT_TO, SLACK, LEAST_BOXES, MOST_CROSSING, CROSSING_SHARE = 250, 750, 8, 3, 2, 0.15


def column_split(boxes: DataFrame, at: float = 500) -> DataFrame:
    """Whether a page reads in two columns: enough boxes, with centres on both sides of a line near the middle that few cross."""
    right = (F.col("x0") + F.col("x1")) / 2 >= at
    over = (F.col("x0") < at - SLACK) & (F.col("x1") > at + SLACK)
    sums = boxes.groupBy("paper_id", "page").agg(F.count_if(~right).alias("left"), F.count_if(right).alias("right"), F.count_if(over).alias("crossing"))
    n = F.col("left") + F.col("right")
    fits = (n >= LEAST_BOXES) & (F.col("left") > 0) & (F.col("right") > 0) & (F.col("crossing") <= F.greatest(F.lit(float(MOST_CROSSING)), n * CROSSING_SHARE))
    return sums.withColumn("columns", F.when(F.lit(SPLIT_FROM <= at <= SPLIT_TO) & fits, 2).otherwise(1))


def white_gap(rows: DataFrame, least: float) -> DataFrame:
    """First run of white rows of at least ``least`` rows on each page: islands of equal ink."""
    island = F.col("y") - F.row_number().over(Window.partitionBy("page_id", "white").orderBy("y"))
    runs = rows.withColumn("_i", island).where("white").groupBy("page_id", "_i").agg(F.min("y").alias("from"), F.count("*").alias("n")).where(F.col("n") >= least)
    return runs.groupBy("page_id").agg(F.min(F.struct("from", "n")).alias("g")).select("page_id", "g.from", "g.n")


def union_area(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Area of the union of each key's boxes, over cells between neighbouring edges."""
    xs = boxes.select(*key, F.explode(F.array("x0", "x1")).alias("x")).distinct()
    slabs = xs.withColumn("to", F.lead("x").over(Window.partitionBy(*key).orderBy("x"))).where("to is not null")
    in_slab = slabs.join(boxes, key).where((F.col("x0") <= F.col("x")) & (F.col("x1") >= F.col("to")))
    by = Window.partitionBy(*key, "x").orderBy("y0", "y1")
    top = F.max("y1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0.0), F.col("y1") - F.greatest(F.col("y0"), F.coalesce(top, F.col("y0"))))
    return in_slab.withColumn("_h", fresh).groupBy(*key).agg(F.sum(F.col("_h") * (F.col("to") - F.col("x"))).alias("area"))


def _with(value: Column, function) -> Column:
    """``function`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _overlap(a: Column, b: Column) -> Column:
    """Area that two boxes of a page have in common."""
    both = lambda c: F.greatest(F.lit(0.0), F.least(a[f"{c}1"], b[f"{c}1"]) - F.greatest(a[f"{c}0"], b[f"{c}0"]))
    return F.when(a["page"] == b["page"], both("x") * both("y")).otherwise(0.0)


def _size(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def common_boxes(a: Column, b: Column) -> Column:
    """What each two boxes of a page of two arrays ``(page, x0, y0, x1, y1)`` have in common."""
    cut = lambda p, q: F.struct(p["page"].alias("page"), F.greatest(p["x0"], q["x0"]).alias("x0"), F.greatest(p["y0"], q["y0"]).alias("y0"), F.least(p["x1"], q["x1"]).alias("x1"), F.least(p["y1"], q["y1"]).alias("y1"))
    return F.flatten(F.transform(a, lambda p: F.transform(F.filter(b, lambda q: _overlap(p, q) > 0), lambda q: cut(p, q))))


def covered(boxes: Column) -> Column:
    """Area of the union of an array of boxes ``(page, x0, y0, x1, y1)``, pages apart: one or two at once, more over cells between neighbouring edges."""

    def height(strip: Column) -> Column:
        none = F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("top"))
        step = lambda h, b: F.struct((h["sum"] + F.greatest(F.lit(0.0), b["y1"] - F.greatest(b["y0"], h["top"]))).alias("sum"), F.greatest(h["top"], b["y1"]).alias("top"))
        return F.aggregate(F.array_sort(F.transform(strip, lambda b: F.struct(b["y0"].alias("y0"), b["y1"].alias("y1")))), none, step, lambda h: h["sum"])

    def page(some: Column) -> Column:
        edges = F.array_sort(F.array_distinct(F.flatten(F.transform(some, lambda b: F.array(b["x0"], b["x1"])))))
        slab = lambda xs, i: (F.get(xs, i) - F.get(xs, i - 1)) * height(F.filter(some, lambda b: (b["x0"] <= F.get(xs, i - 1)) & (b["x1"] >= F.get(xs, i))))
        return _with(edges, lambda xs: F.aggregate(F.sequence(F.lit(1), F.size(xs) - 1), F.lit(0.0), lambda s, i: s + slab(xs, i)))

    def area(all_: Column) -> Column:
        one, two = F.get(all_, F.lit(0)), F.get(all_, F.lit(1))
        pages = F.array_distinct(F.transform(all_, lambda b: b["page"]))
        union = F.aggregate(pages, F.lit(0.0), lambda s, p: s + _with(F.filter(all_, lambda b: b["page"] == p), page))
        return F.when(F.size(all_) == 0, 0.0).when(F.size(all_) == 1, _size(one)).when(F.size(all_) == 2, _size(one) + _size(two) - _overlap(one, two)).otherwise(union)

    return _with(boxes, area)


def covered_by_both(a: Column, b: Column) -> Column:
    """Area that two arrays of boxes both cover."""
    single = (F.size(a) == 1) & (F.size(b) == 1)
    return F.when(single, _overlap(F.get(a, F.lit(0)), F.get(b, F.lit(0)))).otherwise(covered(common_boxes(a, b)))
