"""Flags that stored cards should have by today's rules, added or withdrawn without touching what people decided.

``cards(paper_id, card_id, state, flags, kind, stem, options, analysis, origin,
anchor_seq, approved, edited, checked)``, ``figures(paper_id, card_id, page, x0,
y0, x1, y1, source, slot)``, ``regions(paper_id, card_id, page, x0, y0, x1,
y1)`` and ``blocks(paper_id, seq, page, x0, y0, x1, y1, text)``, boxes in
thousandths of a page. Cards meet blocks by paper and anchor, by paper and
number of a figure, or by paper and page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where figures come from that no reading of the card itself found, and the flags that say so already.
GIVEN, GIVEN_FLAGS = ["other", "row", "shared"], ["other_figure", "row_figure", "shared_figure"]
LETTERS = list("ABCDE")
# Places to fill in, words that mark one; words of tasks that say nothing of their content.
PLACES = r"_{2,}|\\_+|＿+|[（(]\s*[）)]|　{2,}|\\underline|\\qquad|□|口|【\s*】|\|[ \t]*\|"
FILL_WORDS = "填空 填写 填入 填表 填在 填出 填上 横线上 答案处 括号内".split()
TASK_WORDS = "如图所示 求证 计算下列 已知如图 如图， 试求 求下列 下列各式".split()
# The shortest prose that is compared, how much of it, and how much must occur; the highest part of a question.
LEAST_PROSE, PROBE, WINDOW, MOST_PART = 6, 10, 4, 20
#: How far a figure's centre may lie outside; gap and sideways reach of a caption below a figure; reach of a second column and pads of its band.
NEAR, CAPTION_GAP, CAPTION_ABOVE, CAPTION_SIDE, COLUMN_GAP, COLUMN_BACK, BAND = 20.0, 36.0, 2.5, 67.0, 235.0, 8.5, 5.0

_PART = r"(?m)^\s*[（(]\s*([0-9]{1,2})\s*[）)]"
_PRINTED_PART = r"[（(]\s*([0-9]{1,2})\s*[）)]"
_FIGURE = r"图\s*([0-9]+\s*[-—.．]\s*[0-9]+)"
_ROWS = ["paper_id", "card_id"]
BOX = ["page", "x0", "y0", "x1", "y1"]


def _numbers(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    return F.transform(found, lambda n: n.cast("int"))


def _figure_keys(text: Column) -> Column:
    """Numbers of figures as ``4-1``, whatever dash is printed."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_FIGURE), F.lit(1))
    whole = lambda k: F.transform(F.split(k, r"\s*[-—.．]\s*"), lambda n: n.cast("long").cast("string"))
    return F.array_distinct(F.transform(found, lambda k: F.array_join(whole(k), "-")))


def _whole(rows: DataFrame) -> DataFrame:
    return rows.where(" and ".join(f"{c} is not null" for c in BOX))


def _has(flag: str) -> Column:
    return F.exists("flags", lambda f: F.coalesce(F.startswith(f, F.lit(flag)), F.lit(False)))


def _probe(printed: Column, origin: Column) -> Column:
    """The longest prose of the line with a card's number, without source and task words; null if it has none."""
    body = F.regexp_replace(printed, r"^\s*[(（\[【][^)）\]】]*[0-9]{4}[^)）\]】]*[)）\]】]", "")
    body = F.regexp_replace(F.regexp_replace(body, "|".join(TASK_WORDS), ""), r"^\s*[*※＊▲]?\s*[0-9]{1,3}\s*[.．、]", "")
    own = F.regexp_replace(body, r"(?s)[0-9]{1,3}\s*[.．、].*", "")  # a split would compile its pattern once a row
    runs = F.filter(F.regexp_extract_all(own, F.lit(rf"([一-鿿]{{{LEAST_PROSE},}})"), F.lit(1)), lambda r: ~F.contains(F.coalesce(origin, F.lit("")), r))
    longer = lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best)
    return F.reduce(runs, F.lit(""), longer, lambda best: F.when(F.length(best) > 0, F.substring(best, 1, PROBE)))


def mismatch(printed: Column, reading: Column, origin: Column) -> Column:
    """Whether none of the printed prose occurs in a reading, not even four characters; false where nothing can be compared."""
    # a reading that holds the whole line, no word of which is left out, holds all its prose: most cards need no pattern
    holds = F.coalesce(F.contains(reading, printed) & ~reduce(Column.__or__, [F.contains(printed, F.lit(w)) for w in TASK_WORDS]), F.lit(False))
    # bound by a lambda, so that both are made once a card
    once = F.array(F.struct(_probe(printed, origin).alias("probe"), F.regexp_replace(reading, r"\s+", "").alias("text")))
    window = lambda t, i: F.contains(t["text"], F.substr(t["probe"], i, F.lit(WINDOW)))
    shared = lambda t: F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t["probe"]) - WINDOW + 1)), lambda i: window(t, i))
    return ~holds & F.exists(once, lambda t: F.coalesce(t["probe"].isNotNull() & ~shared(t), F.lit(False)))


def _outside(drawn: DataFrame, regions: DataFrame) -> DataFrame:
    """(paper_id, card_id, outside): cards with a figure whose centre lies in none of their regions. Whole boxes only."""
    f = drawn.select(*_ROWS, "page", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    inside = [f[c] == regions[c] for c in (*_ROWS, "page")] + [f["cx"].between(regions["x0"] - NEAR, regions["x1"] + NEAR), f["cy"].between(regions["y0"] - NEAR, regions["y1"] + NEAR)]
    return f.join(regions, inside, "left_anti").groupBy(*_ROWS).agg(F.lit(True).alias("outside"))


def _captions(cards: DataFrame, drawn: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper_id, card_id, cut): numbers that a stem names and that stand right below a figure of the card, outside all of them."""
    lines = _whole(blocks).where(F.contains("text", F.lit("图")) & F.col("text").rlike(rf"^\s*{_FIGURE}\s*$")).select("paper_id", F.struct(*BOX).alias("c"), F.get(_figure_keys(F.col("text")), F.lit(0)).alias("key"))
    named = cards.where(F.contains("stem", F.lit("图"))).select(*_ROWS, F.explode_outer(_figure_keys(F.col("stem"))).alias("key"))
    met = named.join(lines, ["paper_id", "key"]).join(drawn.select(*_ROWS, F.struct(*BOX).alias("f")), _ROWS)
    c, f = F.col("c"), F.col("f")
    on = f["page"] == c["page"]
    inside = on & ((c["x0"] + c["x1"]) / 2).between(f["x0"], f["x1"]) & ((c["y0"] + c["y1"]) / 2).between(f["y0"], f["y1"])
    below = on & (c["y0"] - f["y1"]).between(-CAPTION_ABOVE, CAPTION_GAP) & (c["x1"] >= f["x0"] - CAPTION_SIDE) & (c["x0"] <= f["x1"] + CAPTION_SIDE)
    each = met.groupBy(*_ROWS, "key").agg(F.bool_or(inside).alias("inside"), F.bool_or(below).alias("below"))
    return each.where("below and not inside").groupBy(*_ROWS).agg(F.array_sort(F.collect_set("key")).alias("cut"))


def _second_column(cards: DataFrame, regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper_id, card_id, lost): parts printed right of a card with a gap in its parts, in its band, that no card has."""
    marks = F.filter(_numbers(F.col("stem"), _PART), lambda n: n.between(1, MOST_PART))
    gap = lambda m: (F.size(m) > 1) & (F.get(m, F.lit(0)) == 1) & (F.array_max(m) > F.size(F.array_distinct(m)))  # noqa: E731; of two lines at least
    bits = lambda m: F.reduce(m, F.lit(0), lambda all_, n: all_.bitwiseOR(F.call_function("shiftleft", F.lit(1), n)))
    # bound by lambdas, so that the marks are made once a card; a bit each, so that sums hold them without sorting;
    # explode_outer, as Spark puts a filter that makes the array again before a plain one
    gapped = cards.where(F.col("stem").rlike(r"[\n\r\x85\u2028\u2029]")).select(*_ROWS, F.explode_outer(F.transform(F.filter(F.array(marks), gap), bits)).alias("marks")).where("marks is not null")
    bands = gapped.join(regions, _ROWS).groupBy(*_ROWS, "page").agg(F.bit_or("marks").alias("marks"), F.max("x1").alias("right"), (F.min("y0") - BAND).alias("top"), (F.max("y1") + BAND).alias("bottom"))
    parts = F.regexp_extract_all("text", F.lit(_PRINTED_PART), F.lit(1))
    printed = _whole(blocks).select("paper_id", "page", F.col("x0").alias("x"), F.col("y0").alias("y"), F.explode_outer(parts).alias("n")).where("n is not null").withColumn("n", F.col("n").cast("int"))
    beside = F.col("x").between(F.col("right") - COLUMN_BACK, F.col("right") + COLUMN_GAP) & F.col("y").between(F.col("top"), F.col("bottom"))
    held = (F.col("n") <= MOST_PART) & (F.col("marks").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("n"))) != 0)
    lost = bands.join(printed, ["paper_id", "page"]).where(beside & ~held).select(*_ROWS, "page", "x", "y", "n")
    owned = cards.where(F.col("stem").rlike(r"[（(]")).select(*_ROWS, F.explode_outer(F.array_distinct(marks)).alias("n")).where("n is not null").join(regions, _ROWS).withColumnRenamed("card_id", "other")
    claimed = [lost[c] == owned[c] for c in ("paper_id", "page", "n")] + [lost["card_id"] != owned["other"], lost["x"].between(owned["x0"], owned["x1"]), lost["y"].between(owned["y0"], owned["y1"])]
    free = lost.join(owned, claimed, "left_anti")
    return free.groupBy(*_ROWS).agg(F.array_sort(F.collect_set("n")).alias("lost"))


def reconciled(cards: DataFrame, figures: DataFrame, regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """``cards`` with ``flags`` and ``state`` by all six rules, and ``changed``.

    - ``outside_range``: a figure given from elsewhere lies outside the card's
      regions and no flag says that it was given;
    - ``anchor_mismatch``: the line with the card's number says nothing that
      the reading has; withdrawn where that holds no longer;
    - ``fill_without_slot``: a question to fill in without a place for it;
    - ``subitem_gap:2,4``: parts printed in a column that the card lacks;
    - ``caption_cut:4-1``: a named figure whose number stands below its box;
    - ``slotted_non_choice``: a figure in an option's slot of a question without options.

    Cards that people approved, edited or checked, or whose figures were placed
    by hand, get no flag; they lose a wrong one unless approved or edited. A
    flag turns a green card yellow, a single caption doesn't; a card whose last
    flag goes is green again. Run again, nothing changes. Null flags are none,
    null boxes and texts count for nothing; of an anchor's repeated blocks the
    least text counts.
    """
    regions = _whole(regions).select(*_ROWS, *BOX)
    base = cards.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>"))).select(*cards.columns)
    anchors = blocks.where("seq is not null and text is not null").groupBy("paper_id", F.col("seq").alias("anchor_seq")).agg(F.min("text").alias("printed"))
    given = reduce(Column.__and__, [F.col(c).isNotNull() for c in BOX]) & F.col("source").isin(GIVEN)
    per = figures.groupBy(*_ROWS).agg(F.bool_or(F.col("source") == "manual").alias("by_hand"), F.bool_or(F.col("slot").isin(LETTERS)).alias("slotted"), F.bool_or(given).alias("given"))
    all_ = base.join(anchors, ["paper_id", "anchor_seq"], "left").join(per, _ROWS, "left").join(_outside(_whole(figures), regions), _ROWS, "left")
    all_ = all_.join(_captions(base, _whole(figures), blocks), _ROWS, "left").join(_second_column(base, regions, blocks), _ROWS, "left")

    yes = lambda c: F.coalesce(c, F.lit(False))
    human = yes(F.col("approved")) | yes(F.col("edited"))
    open_ = ~(human | yes(F.col("checked")) | yes(F.col("by_hand")))
    outside = yes(F.col("given")) & yes(F.col("outside"))
    told = F.exists("flags", lambda f: yes(f.isin(GIVEN_FLAGS)))
    options = F.coalesce("options", F.create_map().cast("map<string,string>"))
    reading = F.concat(F.coalesce("stem", F.lit("")), F.array_join(F.map_values(options), ""), F.coalesce("analysis", F.lit("")))
    # comparing texts costs most: once a card, and only where the flag may come or go
    marked, wrong = _has("anchor_mismatch"), F.col("wrong")
    matters = F.col("printed").isNotNull() & ((open_ & ~marked) | (marked & ~human))
    all_ = all_.withColumn("wrong", matters & mismatch(F.col("printed"), reading, F.col("origin")))
    no_place = (F.col("kind") == "fill_blank") & ~F.coalesce("stem", F.lit("")).rlike(PLACES + "|" + "|".join(FILL_WORDS))
    choice = yes(F.col("kind").isin("single_choice", "multiple_choice")) | (F.size(options) > 0)
    listed = lambda name: F.array_join(F.col(name).cast("array<string>"), ",")
    new = {
        "outside_range": (outside & ~told, F.lit("outside_range")),
        "anchor_mismatch": (wrong, F.lit("anchor_mismatch")),
        "fill_without_slot": (no_place, F.lit("fill_without_slot")),
        "subitem_gap": (F.col("lost").isNotNull(), F.concat(F.lit("subitem_gap:"), listed("lost"))),
        "caption_cut": (F.col("cut").isNotNull(), F.concat(F.lit("caption_cut:"), listed("cut"))),
        "slotted_non_choice": (yes(F.col("slotted")) & ~choice, F.lit("slotted_non_choice")),
    }
    none = F.array().cast("array<string>")
    added = F.concat(*[F.when(open_ & ~_has(flag) & yes(holds), F.array(text)).otherwise(none) for flag, (holds, text) in new.items()])
    gone = marked & F.col("printed").isNotNull() & ~human & ~wrong
    kept = F.when(F.col("gone"), F.filter("flags", lambda f: ~yes(F.startswith(f, F.lit("anchor_mismatch"))))).otherwise(F.col("flags"))
    out = all_.withColumns({"added": added, "gone": gone}).withColumn("now", F.concat(kept, F.col("added")))
    grave = F.exists("added", lambda f: ~F.startswith(f, F.lit("caption_cut"))) | yes((F.size("cut") > 1) & F.exists("added", lambda f: F.startswith(f, F.lit("caption_cut"))))
    state = F.when(~F.col("state").isin("green", "yellow"), F.col("state")).when(grave, "yellow").when(F.col("gone"), F.when(F.size("now") > 0, "yellow").otherwise("green")).otherwise(F.col("state"))
    fields = [F.col("now").alias("flags") if c == "flags" else state.alias("state") if c == "state" else F.col(c) for c in cards.columns]
    return out.select(*fields, ((F.size("added") > 0) | F.col("gone")).alias("changed"))
