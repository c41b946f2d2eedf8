"""Pictures of answer options, by the letters printed beside them.

``markers`` are blocks that are an option's letter; ``images`` are candidates of
a card. A letter claims the nearest picture to its right, below or above it, and
only if the next one is clearly farther; what a person has decided stays, and
what can't be decided is reported, not guessed. All joins are within a card's
page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .taxonomy import settled

# Letters of options, kinds with options, types of blocks that can be letters, size of such a block, margin to the next picture.
SLOTS, CHOICES = "ABCDE", ["single_choice", "multiple_choice"]
TEXTS = ["", "text", "paragraph", "list", "list_item", "image_caption"]
TALLEST, LONGEST, MARGIN = 65.0, 160, 12.0

_EXPLICIT = rf"^(?:\(([{SLOTS}])\)|([{SLOTS}])\s*[.、:)])(?:\s|$)"
_ANOTHER = rf"(?:^|\s)(?:\([{SLOTS}]\)|[{SLOTS}]\s*[.、:)])"


def _boxed() -> Column:
    """Whether a row has a page and a proper box."""
    ok = (F.col("page") >= 0) & (F.col("x0") >= 0) & (F.col("x0") < F.col("x1")) & (F.col("x1") <= 1000) & (F.col("y0") >= 0) & (F.col("y0") < F.col("y1")) & (F.col("y1") <= 1000)
    return F.coalesce(ok, F.lit(False))


def markers(blocks: DataFrame) -> DataFrame:
    """(card, slot, seq, page, x0, y0, x1, y1, explicit): blocks that are one option's letter, with or without a text after it."""
    text = F.trim(F.translate(F.coalesce("text", F.lit("")), "（）．：ＡＢＣＤＥ　", "().:ABCDE "))
    named = F.coalesce(F.nullif(F.regexp_extract(text, _EXPLICIT, 1), F.lit("")), F.nullif(F.regexp_extract(text, _EXPLICIT, 2), F.lit("")))
    rest = F.regexp_replace(text, _EXPLICIT, "")
    slot = F.when(named.isNotNull(), F.when(~rest.rlike(_ANOTHER), named)).when(text.rlike(f"^[{SLOTS}]$"), text)
    plain = F.coalesce(F.col("type"), F.lit("")).isin(TEXTS) & ~F.coalesce("manual", F.lit(False))
    found = blocks.where(plain & _boxed() & (F.col("y1") - F.col("y0") <= TALLEST) & (F.length(text) <= LONGEST) & ~text.contains("\n"))
    found = found.select("card", slot.alias("slot"), "seq", "page", "x0", "y0", "x1", "y1", named.isNotNull().alias("explicit")).where("slot is not null")
    return found.groupBy("card", "slot", "page", "x0", "y0", "x1", "y1").agg(F.min_by("explicit", "seq").alias("explicit"), F.min("seq").alias("seq"))


def distance() -> Column:
    """How far a letter (``m_`` columns) is from a picture that it can name, null if it can't."""
    m, c = (lambda k: F.col(f"m_{k}")), F.col
    mx, my, cx, cy = (m("x0") + m("x1")) / 2, (m("y0") + m("y1")) / 2, (c("x0") + c("x1")) / 2, (c("y0") + c("y1")) / 2
    height, gap = c("y1") - c("y0"), c("x0") - m("x1")
    top = (my >= c("y0") - 20) & (my <= c("y0") + F.least(F.lit(60.0), height / 2))
    middle = F.abs(my - cy) <= F.greatest(F.lit(18.0), height * 0.25)
    beside = F.when(gap.between(-2, 50) & (top | middle), F.greatest(F.lit(0.0), gap) + 0.5 * F.least(F.when(top, F.abs(my - c("y0"))), F.when(middle, F.abs(my - cy))))
    shared = F.greatest(F.lit(0.0), F.least(m("x1"), c("x1")) - F.greatest(m("x0"), c("x0")))
    under = shared >= 0.6 * F.least(m("x1") - m("x0"), c("x1") - c("x0"))
    above, below = c("y0") - m("y1"), m("y0") - c("y1")
    return F.least(beside, F.when(under & above.between(0, 35), above + 0.1 * F.abs(mx - cx)), F.when(under & below.between(0, 30), below + 0.1 * F.abs(mx - cx)))


def evidence(cards: DataFrame, blocks: DataFrame, images: DataFrame) -> DataFrame:
    """(card, label, slot, seq, distance, role, reason): what each letter says, and what becomes of it.

    ``cards(card, kind, cue, written)``: kind of question, whether its stem
    points at a figure, letters whose options have text. ``blocks(card, seq,
    page, x0, y0, x1, y1, type, manual, text)``, ``images(card, label, page, x0,
    y0, x1, y1, manual, role)`` with the role that a picture has so far. With a
    reason of null the picture gets the slot. Else the row tells why not:
    ``duplicate_marker`` (the letter stands twice), ``ambiguous`` (two pictures
    are near), ``several_markers`` (two letters name one picture), ``disagrees``
    or ``protected`` (it has another role, which stays). Letters inside a picture
    are no markers, nor are those of written options where the stem points at a
    figure. A single letter without a mark after it counts only beside others.
    """
    choice = cards.where(F.col("kind").isin(CHOICES))
    boxes = images.where(_boxed())
    found = markers(blocks).join(choice.select("card", "cue", "written"), "card")
    m = found.select("card", "slot", "seq", "page", "explicit", "cue", "written", *[F.col(k).alias(f"m_{k}") for k in ("x0", "y0", "x1", "y1")])
    meets = (F.least("m_x1", "x1") > F.greatest("m_x0", "x0")) & (F.least("m_y1", "y1") > F.greatest("m_y0", "y0"))
    at = ["card", "page", "slot", "seq"]
    covered = m.join(boxes.select("card", "page", "x0", "y0", "x1", "y1"), ["card", "page"]).where(meets).select(*at).distinct()
    free = m.join(covered, at, "left_anti").where(~(F.coalesce("cue", F.lit(False)) & F.coalesce(F.array_contains("written", F.col("slot")), F.lit(False))))
    by_card, by_slot = Window.partitionBy("card"), Window.partitionBy("card", "slot")
    used = free.withColumn("slots", F.size(F.collect_set("slot").over(by_card))).where("explicit or slots >= 2").withColumn("n", F.count("*").over(by_slot))
    # images that a machine found and whose label is no other's; without any there is nothing to name
    auto = boxes.where(~F.coalesce("manual", F.lit(False)) & (F.coalesce("label", F.lit("")) != ""))
    valid = auto.withColumn("same", F.count("*").over(Window.partitionBy("card", "label"))).where("same = 1").select("card", "page", "label", "role", "x0", "y0", "x1", "y1")
    used = settled(used.join(valid.select("card").distinct(), "card", "left_semi"))
    near = used.where("n = 1").join(valid, ["card", "page"]).withColumn("d", distance()).where("d is not null")
    ranks = Window.partitionBy("card", "slot").orderBy("d", "label")
    first = settled(near.withColumns({"k": F.row_number().over(ranks), "then": F.lead("d").over(ranks)}).where("k = 1"))
    clear = first.where(F.col("then").isNull() | (F.col("then") - F.col("d") >= MARGIN)).withColumn("claims", F.count("*").over(Window.partitionBy("card", "label")))
    none = lambda kind: F.lit(None).cast(kind)
    said = ["card", "label", "slot", "seq", "distance", "role", "reason"]
    twice = used.where("n > 1").select("card", none("string").alias("label"), "slot", "seq", none("double").alias("distance"), none("string").alias("role"), F.lit("duplicate_marker").alias("reason"))
    unclear = first.where(F.col("then") - F.col("d") < MARGIN).select("card", none("string").alias("label"), "slot", "seq", none("double").alias("distance"), none("string").alias("role"), F.lit("ambiguous").alias("reason"))
    open_role = F.coalesce("role", F.lit("")).isin("", "stem") | (F.col("role") == F.col("slot"))
    reason = F.when(F.col("claims") > 1, "several_markers").when(open_role, none("string")).when(F.col("role").isin(list(SLOTS)), "disagrees").otherwise("protected")
    decided = clear.select("card", "label", "slot", "seq", F.round("d", 2).alias("distance"), "role", reason.alias("reason"))
    return decided.unionByName(twice).unionByName(unclear).select(*said)
