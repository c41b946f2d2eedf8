"""Types of records, quality flags and verdicts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SINGLE, MULTIPLE, BLANK, FREE, UNKNOWN = "single", "multiple", "blank", "free", "unknown"
TYPE_FLAG = "type_unknown"


def section_kind(section: Column) -> Column:
    """The choice type a section's heading fixes; one that names both kinds or question numbers fixes none."""
    one, many = section.rlike(r"(?i)only one|single choice"), section.rlike(r"(?i)more than one|multiple choice")
    numbers = section.rlike(r"(?i)\bno\.? *\d|\d+ *(?:-|to) *\d+")
    return F.when(numbers, UNKNOWN).when(many & ~one, MULTIPLE).when(one & ~many, SINGLE).otherwise(UNKNOWN)


def with_section(kind: Column, section: Column) -> Column:
    """A heading moves a type only between the two choice types."""
    fixed = section_kind(section)
    return F.when(kind.isin(SINGLE, MULTIPLE) & (fixed != UNKNOWN), fixed).otherwise(F.coalesce(kind, F.lit(UNKNOWN)))


def from_words(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("multiple"), MULTIPLE).when(low.contains("single"), SINGLE).when(low.contains("blank"), BLANK).when(low.contains("solve") | low.contains("prove"), FREE).otherwise(UNKNOWN)


def subquestions(stem: Column) -> Column:
    """Length of the run (1), (2)... of labels that begin lines; below two it is none."""
    labels = F.regexp_extract_all(stem, F.lit(r"(?:^|\n)\s*\((\d{1,2})\)"), F.lit(1))
    run = F.aggregate(labels, F.lit(0), lambda n, x: F.when(x.cast("int") == n + 1, n + 1).otherwise(n))
    return F.when(run >= 2, run).otherwise(0)


def infer(kind: Column, stem: Column, options: Column) -> Column:
    """A decided type stays; options make a choice type; two or more subquestions make a free one."""
    some = F.exists(options, lambda o: F.trim(o) != "")
    many = stem.rlike(r"(?i)\b(?:which of the following are|select all)\b")
    guess = F.when(F.coalesce(some, F.lit(False)), F.when(many, MULTIPLE).otherwise(SINGLE)).when(subquestions(stem) >= 2, FREE).otherwise(UNKNOWN)
    return F.when(kind.isNotNull() & (kind != UNKNOWN), kind).otherwise(guess)


def blank_without_slot(kind: Column, stem: Column) -> Column:
    """A fill-in record without any place to fill."""
    return F.coalesce((kind == BLANK) & ~stem.rlike(r"_{2,}|\(\s*\)|\[\s*\]|\\underline|\|[ \t]*\|"), F.lit(False))


def synced_flags(flags: Column, kind: Column) -> Column:
    """Flags with the reminder of an undecided type exactly where it is one."""
    rest = F.array_remove(F.coalesce(flags, F.array().cast("array<string>")), TYPE_FLAG)
    return F.when(kind.isNull() | (kind == UNKNOWN), F.array_append(rest, F.lit(TYPE_FLAG))).otherwise(rest)


def synced_state(state: Column, before: Column, after: Column) -> Column:
    """Only a change of the reminder moves a readable card's state."""
    return F.when(~state.isin("green", "yellow") | (before == after), state).when(F.size(after) > 0, "yellow").otherwise("green")


def figure_cue(stem: Column) -> Column:
    return stem.rlike(r"(?i)\b(?:figure|diagram|as shown|graph below)\b")


def asks_to_draw(stem: Column) -> Column:
    return stem.rlike(r"(?i)\b(?:draw|sketch|construct)\b")


def figure_review(stem: Column, figures: Column, slots: Column, missing: Column, unclassified: Column, excluded: Column) -> Column:
    """Automatic verdict on a record's figures; the first rule that fits decides."""
    cue, draw = figure_cue(stem), asks_to_draw(stem)
    return (
        F.when(missing & (figures == 0) & ~draw, "blocked_missing")
        .when(slots > figures, "blocked_missing")
        .when(cue & (figures == 0), "blocked_missing")
        .when(unclassified > 0, "conflict")
        .when((figures > 0) & ~cue, "conflict")
        .when((figures == 0) & (excluded > 0), "auto_excluded")
        .otherwise("ok")
    )


def printed_marks(text: Column) -> Column:
    """Answer marks ``1. B`` as an array of letters."""
    return F.regexp_extract_all(text, F.lit(r"\d+\s*[.)]\s*([A-E])\b"), F.lit(1))


def option_gaps(options: Column) -> Column:
    """Letters A to D that options lack before their last one."""
    letters = F.array_sort(F.map_keys(options))
    return F.array_except(F.filter(F.array(*[F.lit(x) for x in "ABCD"]), lambda x: x <= F.coalesce(F.array_max(letters), F.lit(""))), letters)


def option_content(options: Column) -> Column:
    """A to D always, E where it is set."""
    base = F.map_from_arrays(F.array(*[F.lit(x) for x in "ABCD"]), F.array(*[F.coalesce(F.element_at(options, x), F.lit("")) for x in "ABCD"]))
    return F.when(F.coalesce(F.element_at(options, "E"), F.lit("")) != "", F.map_concat(base, F.create_map(F.lit("E"), F.element_at(options, "E")))).otherwise(base)


def page_mode(text: Column, image: Column) -> Column:
    """Whether a page's text layer can be used: long enough and readable, or a scan."""
    n = F.length(F.regexp_replace(text, r"\s", ""))
    bad = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\p{P}\p{S}\s]", ""))
    return F.when(n < 20, F.when(image, "scan").otherwise("empty")).when(bad * 10 > n, "unreadable").otherwise("text")


def reading_decision(single: Column, only_a: Column, witness_a: Column, same: Column, choice: Column, arbiter: Column, second_votes: Column, readings: Column) -> Column:
    """The ladder that picks a card's text from stored readings."""
    return (
        F.when(single, "single").when(only_a & witness_a, "witness").when(same, "agree").when(choice.isNotNull(), "majority")
        .when(arbiter.isNotNull() & second_votes, "majority").when(arbiter.isNotNull(), "arbiter").when(readings == 1, "single").when(readings == 0, "none").otherwise("single_flagged")
    )
