"""Faceted filters: one conjunctive predicate, any facet of which may be left out."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .taxonomy import descendants

MOST_TERMS, MOST_IDS = 8, 500
TAG_FACET = "tags"


@dataclass(frozen=True)
class FilterSpec:
    """What a search asks for. Empty fields don't filter."""

    status: str | None = "published"
    paper: str | None = None
    kind: str | None = None
    review_source: str | None = None
    answer: str | None = None  # "yes" or "no"
    body_mode: str | None = None  # "text" or "image"
    tag_all: tuple[str, ...] = ()
    tag_any: tuple[str, ...] = ()
    tag_not: tuple[str, ...] = ()
    untagged: bool = False
    needs_review: bool = False
    q: str = ""
    ids: tuple = field(default=())

    def facets(self) -> list[str]:
        """Facets that filter; all tag filters are one."""
        plain = [f for f in ("paper", "kind", "review_source", "answer", "body_mode") if getattr(self, f) is not None]
        tags = any((self.tag_all, self.tag_any, self.tag_not, self.untagged, self.needs_review))
        return plain + [TAG_FACET] * tags


def terms(q: str) -> list[str]:
    return q.lower().split()[:MOST_TERMS]


def normalize_ids(values) -> list[int]:
    """Valid ids in the order given, without repeats; one malformed id makes the list unusable (None)."""
    out: dict[int, None] = {}
    for v in values:
        if not str(v).lstrip("-").isdigit():
            return []
        out[int(v)] = None
    if len(out) > MOST_IDS:
        raise ValueError(f"at most {MOST_IDS} ids")
    return list(out)


def answer_present() -> Column:
    """The filter's notion: neither null nor empty; white space counts as an answer."""
    return F.coalesce(F.col("answer"), F.lit("")) != ""


def facet_predicates(spec: FilterSpec) -> dict[str, Column]:
    """The row predicate of each facet that filters, but for the tags."""
    same = {f: F.col(c) == getattr(spec, f) for f, c in (("paper", "paper_id"), ("kind", "kind"), ("review_source", "review_source")) if getattr(spec, f) is not None}
    if spec.answer is not None:
        same["answer"] = answer_present() if spec.answer == "yes" else ~answer_present()
    if spec.body_mode is not None:
        same["body_mode"] = F.col("body_mode") == "image" if spec.body_mode == "image" else F.col("body_mode").isNull() | (F.col("body_mode") == "text")
    return same


def predicates(spec: FilterSpec, omit: str | None = None) -> list[Column]:
    """Row predicates of ``spec`` without the facet ``omit``. The text search is never left out."""
    out = [F.col("status") == spec.status] if spec.status else []
    out += [p for facet, p in facet_predicates(spec).items() if facet != omit]
    return out + [F.contains("search_text", F.lit(t)) for t in terms(spec.q)]


def library_rows(pubs: DataFrame, spec: FilterSpec, assignments: DataFrame | None = None, edges: DataFrame | None = None, omit: str | None = None) -> DataFrame:
    """``pubs`` that ``spec`` asks for, as semi and anti joins over the tags' subtrees.

    Only confirmed links count. An id list with a malformed entry gives no rows.
    """
    rows = reduce(lambda df, p: df.where(p), predicates(spec, omit), pubs)
    if spec.ids:
        ids = normalize_ids(spec.ids)
        rows = rows.where(F.col("id").isin(ids) if ids else F.lit(False))
    if omit == TAG_FACET or TAG_FACET not in spec.facets():
        return rows
    confirmed = assignments.where("not needs_review")
    if spec.tag_all:
        closure = descendants(edges, spec.tag_all)
        hit = confirmed.join(closure, confirmed["tag_id"] == closure["tag"]).groupBy(F.col("publication_id").alias("id")).agg(F.countDistinct("root").alias("n"))
        rows = rows.join(hit.where(F.col("n") == len(set(spec.tag_all))), "id", "left_semi")
    for wanted, how in ((spec.tag_any, "left_semi"), (spec.tag_not, "left_anti")):
        if wanted:
            rows = rows.join(linked(confirmed, descendants(edges, wanted)), "id", how)
    if spec.untagged:
        rows = rows.join(confirmed.select(F.col("publication_id").alias("id")), "id", "left_anti")
    if spec.needs_review:
        rows = rows.join(assignments.where("needs_review").select(F.col("publication_id").alias("id")), "id", "left_semi")
    return rows


def linked(assignments: DataFrame, closure: DataFrame) -> DataFrame:
    """Ids of the publications with a link into the closure."""
    return assignments.join(closure, assignments["tag_id"] == closure["tag"], "left_semi").select(F.col("publication_id").alias("id"))


def json_truthy(value: Column) -> Column:
    """Whether a JSON text holds something: 0, "", [], {}, false and null do not."""
    v = F.trim(value)
    number = v.try_cast("double")
    return F.coalesce(~v.isin("", "null", "false", '""', "[]", "{}") & ~F.coalesce(number == 0, F.lit(False)), F.lit(False))


def review_query(q: str) -> tuple[int | None, int | None, list[str]]:
    """A search of cards: ``page:N``, ``no:N`` and text terms."""
    page = number = None
    words = []
    for part in q.lower().split():
        head, _, tail = part.partition(":")
        if head == "page" and tail.isdigit():
            page = int(tail)
        elif head == "no" and tail.isdigit():
            number = int(tail)
        else:
            words.append(part)
    return page, number, words
