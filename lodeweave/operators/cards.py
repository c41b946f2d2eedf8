"""Records under review: content, flags, verdicts, edits of their layout, suggestions and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .merge import matched_cards
from .sequences import ordered_groups


def content(rows: DataFrame) -> DataFrame:
    """The publishable content of each record as one struct."""
    return rows.select("id", F.struct("number", "kind", "stem", F.coalesce("answer", F.lit("")).alias("answer"), F.struct("paper_id").alias("origin")).alias("content"))


def flag_rules(cards: DataFrame) -> DataFrame:
    """``(id, flag)`` of all rules that a card breaks, each rule a predicate of one pass."""
    rules = {
        "no_region": F.size("regions") == 0,
        "outside": F.exists("regions", lambda r: (r["x0"] < 0) | (r["y1"] > 1000)),
        "no_number": F.col("number").isNull(),
        "no_slot": (F.col("kind") == "blank") & ~F.col("stem").contains("__"),
        "no_subitems": F.col("stem").rlike(r"\(1\)") & ~F.col("stem").rlike(r"\(2\)"),
        "no_caption": (F.col("figures") > 0) & ~F.col("stem").rlike("(?i)figure"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(f)) for f, p in rules.items()]))
    return cards.select("id", F.explode(broken).alias("flag"))


def verdicts(cards: DataFrame) -> DataFrame:
    """State of each card: whether its approval is current, what blocks it, whether it is settled."""
    current = F.coalesce(F.col("approved_hash") == F.col("hash"), F.lit(False))
    blocked = F.col("figure_verdict").isin("blocked_missing", "conflict")
    return cards.select("id", "state", current.alias("approval_current"), blocked.alias("blocked"), (current & ~blocked & F.col("state").isin("green", "yellow")).alias("settled"))


def cut_protection(cards: DataFrame, operations: DataFrame) -> DataFrame:
    """Why a card's cut must not change by itself: published, approved, or edited by hand."""
    edited = operations.where("actor = 'human'").select("id").distinct().withColumn("_e", F.lit(True))
    joined = cards.join(edited, "id", "left")
    reason = F.when(F.col("published"), "published").when(F.col("approved"), "approved").when(F.col("_e"), "edited")
    return joined.select("id", reason.alias("reason"))


def moved_instructions(candidates: DataFrame) -> DataFrame:
    """Start candidates without instruction items: a run 1, 2... that ends before the next 1 and has no question."""
    by = Window.partitionBy("paper_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    runs = candidates.withColumn("_run", F.sum((F.col("number") == 1).cast("int")).over(by))
    kind = runs.groupBy("paper_id", "_run").agg(F.bool_or("question").alias("_q"), F.count("*").alias("_n"))
    last = kind.groupBy("paper_id").agg(F.max("_run").alias("_last"))
    drop = kind.join(last, "paper_id").where((F.col("_run") < F.col("_last")) & ~F.col("_q")).select("paper_id", "_run")
    return runs.join(drop, ["paper_id", "_run"], "left_anti").drop("_run")


def leading_repair(starts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Papers whose first start is number 2: the block that most likely is number 1, the first before it with a question's word."""
    first = starts.groupBy("paper_id").agg(F.min(F.struct("seq", "number")).alias("f")).where("f.number = 2").select("paper_id", F.col("f.seq").alias("_before"))
    before = blocks.join(first, "paper_id").where((F.col("seq") < F.col("_before")) & F.col("text").rlike(r"^(What|Which|How|Find)"))
    return before.groupBy("paper_id").agg(F.min("seq").alias("seq")).withColumn("number", F.lit(1))


def group_suggestions(scopes: DataFrame) -> DataFrame:
    """Numbering scopes as groups: first and last page, and whether a person must confirm (an exam with several)."""
    groups = scopes.groupBy("paper_id", "scope").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    several = F.count("*").over(Window.partitionBy("paper_id")) > 1
    return groups.withColumn("confirm", several)


def stranded_figures(figures: DataFrame, questions: DataFrame, band: float = 60) -> DataFrame:
    """Figures without an owner, for the only question whose region ends within the band above or begins within it below."""
    free = figures.where("owner is null")
    near = free.join(questions, ["paper_id", "page"]).where((F.abs(F.col("q_y1") - F.col("y0")) <= band) | (F.abs(F.col("q_y0") - F.col("y1")) <= band))
    return near.groupBy("paper_id", "seq").agg(F.countDistinct("number").alias("_n"), F.min("number").alias("number")).where("_n = 1").drop("_n")


def resegment_preview(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """What a new segmentation would do to each card: keep, move, add, or drop; protected cards stay."""
    both = existing.alias("e").join(desired.alias("d"), (F.col("e.paper_id") == F.col("d.paper_id")) & (F.col("e.number") == F.col("d.number")), "full_outer")
    action = F.when(F.col("e.number").isNull(), "add").when(F.col("e.protected"), "protected").when(F.col("d.number").isNull(), "drop").when(F.col("e.y0") == F.col("d.y0"), "keep").otherwise("move")
    return both.select(F.coalesce("e.paper_id", "d.paper_id").alias("paper_id"), F.coalesce("e.number", "d.number").alias("number"), action.alias("action"))


def resegment_matched(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """What a new segmentation would do, by cards that match (:func:`.merge.matched_cards`): (paper_id, item, card, by, action).

    Protected cards stay; a card keeps its place where number and place are equal.
    """
    pairs = matched_cards(existing, desired)
    old = existing.select("paper_id", F.col("card").cast("long").alias("card"), F.col("number").alias("was_number"), F.col("place").alias("was_place"), "protected")
    new = desired.select("paper_id", F.col("item").cast("long").alias("item"), "number", "place")
    both = pairs.join(old, ["paper_id", "card"], "left").join(new, ["paper_id", "item"], "left")
    same = (F.col("number") == F.col("was_number")) & (F.col("place") == F.col("was_place"))
    action = F.when(F.col("card").isNull(), "add").when(F.coalesce("protected", F.lit(False)), "protected").when(F.col("item").isNull(), "drop").when(same, "keep").otherwise("move")
    return both.select("paper_id", "item", "card", "by", action.alias("action"))


def resolve_suggestions(suggestions: DataFrame, decisions: DataFrame, tags: DataFrame) -> DataFrame:
    """Suggestion after decisions: accepted where its tag is active, else stale; undecided stay pending."""
    joined = suggestions.join(decisions, "suggestion_id", "left").join(tags.select("tag_id", "active"), "tag_id", "left")
    state = F.when(F.col("decision").isNull(), "pending").when(F.col("decision") == "reject", "rejected").when(F.coalesce("active", F.lit(False)), "accepted").otherwise("stale")
    return joined.select("suggestion_id", "tag_id", state.alias("state"))


def checked_output(raw: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Structured output of a model: parsed entries with the first rule each breaks, or null."""
    entry = "array<struct<kind:string,name:string,levels:array<string>,rationale:string>>"
    parsed = raw.withColumn("_p", F.from_json("output", entry))
    each = parsed.select("id", F.posexplode_outer("_p").alias("pos", "e"))
    error = F.when(F.col("e").isNull(), "malformed").when(~F.coalesce(F.col("e.kind").isin(*kinds), F.lit(False)), "kind").when(F.trim(F.coalesce("e.name", F.lit(""))) == "", "name").when(F.length("e.name") > 40, "long").when(F.size(F.coalesce("e.levels", F.array().cast("array<string>"))) > 3, "levels")
    return each.select("id", "pos", F.col("e.kind").alias("kind"), F.col("e.name").alias("name"), error.alias("error"))


def blueprint_import(tags: DataFrame, template: DataFrame) -> DataFrame:
    """Template rows with what an import does: keep an equal name and kind, add the rest; a parent that is unknown is an error."""
    known = tags.select(F.lower("name").alias("_n"), "kind", "tag_id")
    matched = template.join(known, (F.lower(template["name"]) == F.col("_n")) & (template["kind"] == known["kind"]), "left").select(template["name"], template["kind"], "parent", "tag_id")
    parents = template.select(F.col("name").alias("_p")).union(tags.select("name")).distinct()
    out = matched.join(parents, F.lower("parent") == F.lower("_p"), "left")
    action = F.when(F.col("parent").isNotNull() & F.col("_p").isNull(), "no_parent").when(F.col("tag_id").isNotNull(), "keep").otherwise("add")
    return out.groupBy("name", "kind", "parent").agg(F.max(action).alias("action"))


# Gray level below which a pixel is ink, shares of dark pixels of a page of print, scatter of its paper, contrast, distance from the level.
INK, LEAST_DARK, MOST_DARK, PAPER_SCATTER, CONTRAST, CLEAR = 170, 0.005, 0.45, 8.0, 24.0, 6.0


def ink_levels(pixels: DataFrame) -> DataFrame:
    """(page_id, level): the gray below which a strip's pixels are ink, from ``pixels(page_id, y, value)`` of 0 to 255.

    The histogram is split where the two sides lie farthest apart, as between
    classes. Print on even paper whose gray the fixed level would miss gets the
    gray that most of its paper has, everything darker is ink; shadows, specks
    and groups that overlap keep the fixed level.
    """
    counts = pixels.groupBy("page_id", F.col("value").cast("double").alias("value")).agg(F.count("*").cast("double").alias("n"))
    by = Window.partitionBy("page_id").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("page_id")
    v, n = F.col("value"), F.col("n")
    sums = counts.withColumns({"dn": F.sum(n).over(by), "ds": F.sum(v * n).over(by), "dq": F.sum(v * v * n).over(by), "an": F.sum(n).over(whole), "as": F.sum(v * n).over(whole), "aq": F.sum(v * v * n).over(whole)})
    c = F.col
    ln, ls, lq = c("an") - c("dn"), c("as") - c("ds"), c("aq") - c("dq")
    dm, lm = c("ds") / c("dn"), ls / ln
    split = sums.where(ln > 0).withColumns({"apart": c("dn") * ln * (lm - dm) * (lm - dm), "dm": dm, "lm": lm, "dsd": F.sqrt(F.greatest(F.lit(0.0), c("dq") / c("dn") - dm * dm)), "lsd": F.sqrt(F.greatest(F.lit(0.0), lq / ln - lm * lm))})
    best = split.groupBy("page_id").agg(F.max_by(F.struct("value", "dn", "an", "dm", "lm", "dsd", "lsd"), F.struct("apart", -v)).alias("b"))
    paper = counts.join(best, "page_id").where(v > c("b.value")).groupBy("page_id").agg(F.max_by("value", F.struct("n", -v)).alias("paper"), F.first("b").alias("b"))
    b = lambda k: F.col(f"b.{k}")
    print_on_paper = (b("dn") / b("an")).between(LEAST_DARK, MOST_DARK) & (b("lsd") <= PAPER_SCATTER) & (b("lm") - b("dm") >= F.greatest(F.lit(CONTRAST), 4 * (b("dsd") + b("lsd"))))
    known = (b("lm") > INK + CLEAR) & (b("dm") < INK - CLEAR)
    level = F.when(print_on_paper & ~known, F.greatest(b("value") + 1, F.col("paper"))).otherwise(float(INK))
    return counts.select("page_id").distinct().join(paper.select("page_id", level.alias("level")), "page_id", "left").select("page_id", F.coalesce("level", F.lit(float(INK))).alias("level"))


def ink_profile(pixels: DataFrame) -> DataFrame:
    """(page_id, y, ink): share of each row's pixels that are ink by their strip's own level."""
    dark = (F.col("value") < F.col("level")).cast("int")
    return pixels.join(ink_levels(pixels), "page_id").groupBy("page_id", "y").agg(F.avg(dark).alias("ink"))


def snapped_cuts(cuts: DataFrame, gaps: DataFrame, reach: float = 15) -> DataFrame:
    """Each cut moved to the middle of the nearest white gap within reach, else left; of two as near the upper one.

    The nearest are the last middle above and the first one below, so a window
    over a page's bands of twice the reach finds them: no pairs are made, and a
    band's neighbours lend it no more than their outermost middles.
    """
    band = lambda at: F.floor(at / (2 * reach))
    middles = gaps.select("page_id", ((F.col("from") + F.col("to")) / 2).alias("m")).where("page_id is not null and m is not null").distinct()
    by_band = middles.select("page_id", band(F.col("m")).alias("band"), "m")
    ends = by_band.groupBy("page_id", "band").agg(F.min("m").alias("first"), F.max("m").alias("last"))
    lent = ends.select("page_id", F.inline(F.array(F.struct((F.col("band") - 1).alias("band"), F.col("first").alias("m")), F.struct((F.col("band") + 1).alias("band"), F.col("last").alias("m")))))
    at = F.col("y").cast("double")
    rows = cuts.select("page_id", "cut_id", at.alias("y"), band(at).alias("band"), F.lit(None).cast("double").alias("m"), F.lit(True).alias("cut"))
    spots = by_band.unionByName(lent).select("page_id", F.lit(None).cast(cuts.schema["cut_id"].dataType).alias("cut_id"), F.col("m").alias("y"), "band", "m", F.lit(False).alias("cut"))
    # both frames end at the row, as one that begins there would be read anew for each row
    upto = lambda order: Window.partitionBy("page_id", "band").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = rows.unionByName(spots).withColumns({"up": F.last("m", True).over(upto(F.asc("y"))), "down": F.last("m", True).over(upto(F.desc("y")))}).where("cut")
    far = lambda m: F.abs(F.col(m) - F.col("y"))
    within = lambda m: F.when(far(m) <= reach, F.struct(far(m).alias("d"), F.col(m).alias("m")))
    best = F.min(F.least(within("up"), within("down"))).over(Window.partitionBy("page_id", "cut_id"))  # of an id's repeated cuts
    return near.select("page_id", "cut_id", F.coalesce(F.when(F.col("cut_id").isNotNull(), best["m"]), F.col("y")).alias("y"))


def _lines(rows: list) -> list[tuple]:
    line, used, out = 1, 0.0, []
    for r in rows:
        if used and used + r.width > r.room:
            line, used = line + 1, 0.0
        used += r.width
        out.append((r.draft_id, r.seq, line))
    return out


def figure_lines(figures: DataFrame) -> DataFrame:
    """Figures of a draft packed into lines in order: a line ends where the next one doesn't fit."""
    return ordered_groups(figures, "draft_id", ["seq"], _lines, "draft_id long, seq int, line int")


def fair_widths(widths: Column, room: float) -> Column:
    """Column widths for ``room``: narrow ones keep theirs, wide ones share the rest equally (a water level)."""
    order = F.array_sort(widths)
    n = F.size(order)
    level = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.struct(F.lit(float(room)).alias("left"), F.lit(None).cast("double").alias("level")),
        lambda s, i: F.when(s["level"].isNotNull(), s).when(F.get(order, i) * (n - i) <= s["left"], F.struct((s["left"] - F.get(order, i)).alias("left"), s["level"].alias("level"))).otherwise(F.struct(s["left"].alias("left"), (s["left"] / (n - i)).alias("level"))),
        lambda s: s["level"],
    )
    return F.transform(widths, lambda w: F.least(w, F.coalesce(level, w)))


def layout_hash(boxes: DataFrame) -> DataFrame:
    """Fingerprint of each paper's layout: its boxes in order, to one decimal."""
    one = F.concat_ws(",", "page", *[F.round(c, 1).cast("decimal(8,1)").cast("string") for c in ("x0", "y0", "x1", "y1")])
    ordered = F.array_sort(F.collect_list(F.struct("seq", one.alias("t"))))
    return boxes.groupBy("paper_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["t"]), ";"), 256).alias("hash"))


def generation_hash(rows: DataFrame, task: str) -> DataFrame:
    """What a generated text depends on: the task's wording, the record's fields and its pictures' digests."""
    parts = [F.lit(task), F.coalesce("stem", F.lit("")), F.coalesce("answer", F.lit("")), F.array_join(F.array_sort("digests"), ",")]
    return rows.select("id", F.sha2(reduce(lambda a, b: F.concat(a, F.lit("\x1f"), b), parts), 256).alias("hash"))


def drop_solution(stem: Column) -> Column:
    """A stem without a printed solution after it."""
    return F.regexp_replace(stem, r"(?is)\n\s*(?:solution|answer)\s*[:.].*$", "")


def anchor_mismatch(printed: Column, reading: Column) -> Column:
    """Whether a reading begins with another number than the page prints."""
    n = F.regexp_extract(reading, r"^\s*(\d{1,3})\s*[.)]", 1)
    return (n != "") & (n.try_cast("int") != printed)


def clean_stem(stem: Column) -> Column:
    """A stem without its number, outer blanks and doubled empty lines."""
    return F.regexp_replace(F.trim(F.regexp_replace(stem, r"^\s*\d{1,3}\s*[.)]\s*", "")), r"\n{3,}", "\n\n")


def fix_symbols(text: Column) -> Column:
    """Box signs before vertex letters mean a parallelogram; other boxes stay."""
    return F.regexp_replace(text, r"[□◻]\s*(?=[A-Z]{2,5}\b)", "▱")


def spot_place(text: Column, before: Column, spot: Column) -> Column:
    """Place of a reported spot in a raw text, from 1; 0 where its surroundings don't occur."""
    found = F.position(F.concat(before, spot), text)
    return F.when(found > 0, found + F.length(before)).otherwise(0)
