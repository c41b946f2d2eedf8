"""Facet counts, work counters and other aggregations over published records."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import FilterSpec, facet_predicates, library_rows
from .taxonomy import tag_counts

KINDS = ("en", "de", "fr")
OTHER = "other"


def folded_kind() -> Column:
    """Unknown kinds count as the default one."""
    return F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(OTHER)


def facet_counts(pubs: DataFrame, spec: FilterSpec, assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """``(facet, value, count)``; each facet is counted with all filters but its own.

    One pass serves all: a row that passes every filter counts for each facet,
    one that fails a single facet's filter counts for that facet. An answer of
    white space counts as "no" here, though the filter takes it for one; a text
    body is what is no image.
    """
    values = {
        "paper": F.col("paper_id"),
        "kind": folded_kind(),
        "review_source": F.coalesce("review_source", F.lit("none")),
        "answer": F.when(F.trim(F.coalesce("answer", F.lit(""))) != "", "yes").otherwise("no"),
        "body_mode": F.when(F.coalesce("body_mode", F.lit("")) == "image", "image").otherwise("text"),
    }
    own = facet_predicates(spec)
    rows = library_rows(pubs, replace(spec, **dict.fromkeys(own)), assignments, edges)
    failed = F.filter(F.array(*[F.when(~F.coalesce(p, F.lit(False)), f) for f, p in own.items()]).cast("array<string>"), lambda f: f.isNotNull())
    near = rows.select(*[v.cast("string").alias(f) for f, v in values.items()], failed.alias("failed")).where("size(failed) <= 1")
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in values])
    asked = F.filter(pairs, lambda p: (F.size("failed") == 0) | F.array_contains("failed", p["facet"]))
    # Counting combinations first keeps what is unfolded small.
    counted = near.groupBy(*values, "failed").agg(F.count("*").alias("n"))
    return counted.select("n", F.inline(asked)).groupBy("facet", "value").agg(F.sum("n").alias("count"))


def tag_facet(pubs: DataFrame, spec: FilterSpec, assignments: DataFrame, edges: DataFrame, tags: DataFrame) -> DataFrame:
    return tag_counts(library_rows(pubs, spec, assignments, edges, omit="tags"), assignments, edges, tags)


def source_facet(rows: DataFrame, renamed: DataFrame) -> DataFrame:
    """Publications, first and last number of each source file, folded over files that were renamed to one name."""
    first = rows.groupBy("paper_id").agg(F.count("*").alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi"))
    named = first.join(renamed, "paper_id", "left")
    return named.groupBy(F.coalesce("name", "paper_id").alias("source")).agg(F.sum("n").alias("count"), F.min("lo").alias("first_number"), F.max("hi").alias("last_number"))


def dimension_presence(rows: DataFrame) -> DataFrame:
    """Conditional counts in one pass."""
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.trim(F.coalesce("answer", F.lit(""))) != "").alias("with_answer"),
        F.count_if(F.coalesce("body_mode", F.lit("")) == "image").alias("image_bodies"),
        F.count_if(F.col("review_source").isNull()).alias("unreviewed"),
        F.countDistinct("paper_id").alias("papers"),
    )


def work_counters(pubs: DataFrame, assignments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Ids still to tag, in work, and to review: differences and unions of sets of ids."""
    live = pubs.where("status = 'published'").select("id")
    tagged = assignments.where("not needs_review").select(F.col("publication_id").alias("id"))
    busy = jobs.where("state in ('queued', 'running')").select("id")
    untagged = live.join(tagged, "id", "left_anti")
    review = assignments.where("needs_review").select(F.col("publication_id").alias("id")).union(jobs.where("state = 'pending'").select("id")).distinct().join(live, "id", "left_semi")
    count = lambda df, name: df.distinct().agg(F.count("*").alias("count")).select(F.lit(name).alias("counter"), "count")
    return count(untagged, "untagged").union(count(untagged.join(busy, "id", "left_anti"), "untagged_ready")).union(count(busy.join(live, "id", "left_semi"), "in_work")).union(count(review, "to_review"))


def answer_inventory(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """Records by state of their answer: missing, blank or present."""
    state = F.when(F.col(answer).isNull() | (F.col(answer) == ""), "missing").when(F.trim(answer) == "", "blank").otherwise("present")
    return rows.groupBy("paper_id").agg(*[F.count_if(state == s).alias(s) for s in ("missing", "blank", "present")])


def top_issues(cards: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent entries of ``issues``; ties by name."""
    return cards.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "issue").limit(most)


def bulk_counts(questions: DataFrame, key: str = "paper_id") -> DataFrame:
    """Live and deleted records of each paper."""
    return questions.groupBy(key).agg(F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"))


def consensus(votes: DataFrame, key: str, label: str) -> DataFrame:
    """The one known label of each key, else ``unknown``."""
    known = F.when(F.col(label) != "unknown", F.col(label))
    return votes.groupBy(key).agg(F.when(F.countDistinct(known) == 1, F.max(known)).otherwise("unknown").alias("label"))


def claim_ledger(claims: DataFrame) -> DataFrame:
    """Frames that several records claim: ``(frame, claimants, winner)``; the only claimant with a cue wins."""
    some = claims.groupBy("frame").agg(F.array_sort(F.collect_set("record")).alias("claimants"), F.countDistinct(F.when(F.col("cue"), F.col("record"))).alias("_cued"), F.max(F.when(F.col("cue"), F.col("record"))).alias("_w"))
    return some.where(F.size("claimants") > 1).select("frame", "claimants", F.when(F.col("_cued") == 1, F.col("_w")).alias("winner"))


def numbering_verdict(lines: DataFrame, key: str) -> DataFrame:
    """Whether a document's numbered lines are topics rather than questions, from shares of them."""
    sums = lines.groupBy(key).agg(F.count("*").alias("lines"), F.avg(F.col("topic").cast("int")).alias("topics"), F.avg(F.col("stem").cast("int")).alias("stems"))
    verdict = F.when((F.col("lines") >= 3) & (F.col("topics") >= 0.3) & (F.col("stems") <= 0.4), "topics").otherwise("questions")
    return sums.select(key, "lines", verdict.alias("verdict"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table of a bundle."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.union(one)
    return out


def migration_report(assignments: DataFrame, tags: DataFrame) -> DataFrame:
    """Links by kind and tag without any record's content, as lines of a table."""
    named = assignments.join(tags, "tag_id")
    return named.groupBy("kind", "name").agg(F.count("*").alias("links"), F.count_if("needs_review").alias("pending")).select(F.concat_ws(" | ", "kind", "name", F.col("links").cast("string"), F.col("pending").cast("string")).alias("row"))


def rotation(backups: DataFrame, keep: int) -> DataFrame:
    """Backups beyond the newest ``keep`` of each series."""
    newest = Window.partitionBy("series").orderBy(F.desc("created_at"), F.desc("backup_id"))
    return backups.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") > keep).drop("_r")
