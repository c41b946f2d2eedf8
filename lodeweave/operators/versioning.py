"""Immutable versions: publishing, carrying over, batches, and logs that can be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(**fields) -> Column:
    """Canonical text of named values: keys sorted, no blanks, null distinct from empty."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.to_json(F.array(fields[k].cast("string"))), F.lit("[null]"))) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def content_hash(**fields) -> Column:
    return F.sha2(canonical(**fields), 256)


def publish(published: DataFrame, drafts: DataFrame) -> DataFrame:
    """What publishing ``drafts(question_id, hash, approved_hash, state)`` does.

    Refused when not approved, not ready, or changed since approval; no new
    version where the newest published one has the hash; else one version more.
    """
    ranked = published.withColumn("_r", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("version"), F.desc("id"))))
    newest = published.groupBy("question_id").agg(F.max("version").alias("top"))
    live = ranked.where("status = 'published'").withColumn("_l", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("version")))).where("_l = 1").select("question_id", F.col("hash").alias("live_hash"), F.col("version").alias("live_version"))
    joined = drafts.join(newest, "question_id", "left").join(live, "question_id", "left")
    action = F.when(F.col("approved_hash").isNull(), "not_approved").when(~F.col("state").isin("green", "yellow"), "not_ready").when(F.col("approved_hash") != F.col("hash"), "changed").when(F.col("live_hash") == F.col("hash"), "same").otherwise("new")
    return joined.select("question_id", action.alias("action"), F.when(action == "new", F.coalesce("top", F.lit(0)) + 1).when(action == "same", F.col("live_version")).alias("version"))


def carried(versions: DataFrame) -> DataFrame:
    """Extras of a version that has none, from the version before where the content's hash is equal."""
    by = Window.partitionBy("question_id").orderBy("version")
    same = F.lag("hash").over(by) == F.col("hash")
    return versions.withColumn("extras", F.coalesce("extras", F.when(same, F.lag("extras").over(by))))


def batch(rows: DataFrame, requests: DataFrame, allowed: str, to: str) -> DataFrame:
    """A batch of status changes: each request's outcome and reason; other rows are untouched."""
    first = requests.groupBy("id").agg(F.min("position").alias("position"))
    joined = first.join(rows.select("id", "status"), "id", "left")
    reason = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != allowed, F.concat(F.lit("is_"), F.col("status")))
    return joined.select("position", "id", reason.isNull().alias("done"), reason.alias("reason"), F.when(reason.isNull(), F.lit(to)).otherwise(F.col("status")).alias("status"))


def assign(links: DataFrame, requests: DataFrame, revisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compare-and-set changes of links: ``(outcomes, links after)``.

    ``requests(request_id, hash, publication_id, tag_id, op, expected)``; a
    request id seen twice counts once, with another hash it is a conflict; a
    request whose expected revision is not the publication's changes nothing.
    """
    seen = Window.partitionBy("request_id", "publication_id", "tag_id").orderBy("hash")
    marked = requests.withColumns({"_n": F.row_number().over(seen), "_odd": F.min("hash").over(Window.partitionBy("request_id")) != F.max("hash").over(Window.partitionBy("request_id"))})
    judged = marked.join(revisions, "publication_id", "left")
    outcome = F.when(F.col("_odd"), "conflict").when(F.col("_n") > 1, "replayed").when(F.col("revision").isNull(), "not_found").when(F.col("revision") != F.col("expected"), "stale").otherwise("done")
    outcomes = judged.withColumn("outcome", outcome)
    done = outcomes.where("outcome = 'done'")
    gone = done.where("op = 'remove'").select("publication_id", "tag_id")
    added = done.where("op = 'add'").select("publication_id", "tag_id", F.lit(False).alias("needs_review"))
    kept = links.join(gone.union(added.select("publication_id", "tag_id")), ["publication_id", "tag_id"], "left_anti")
    after = kept.unionByName(added.distinct())
    return outcomes.select("request_id", "publication_id", "tag_id", "outcome"), after


def replace_tag(links: DataFrame, old: str, new: str) -> DataFrame:
    """Links with one tag replaced in place; a link to the new tag that is there already stays."""
    moved = links.where(F.col("tag_id") == old).withColumn("tag_id", F.lit(new))
    rest = links.where(F.col("tag_id") != old)
    return rest.unionByName(moved.join(rest, ["publication_id", "tag_id"], "left_anti"))


def undo(log: DataFrame) -> DataFrame:
    """The state before the newest operation on each key, where that operation may be undone.

    ``log(op_id, key, before, after, current)``: only if the current value is
    still what the operation left.
    """
    newest = Window.partitionBy("key").orderBy(F.desc("op_id"))
    last = log.withColumn("_r", F.row_number().over(newest)).where("_r = 1")
    ok = F.col("after").eqNullSafe(F.col("current"))
    return last.select("key", "op_id", ok.alias("undone"), F.when(ok, F.col("before")).otherwise(F.col("current")).alias("value"))


def rename_source(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Renames a source and derives the hash anew; other rows keep theirs."""
    hit = F.col("paper_id") == old
    return rows.withColumns({"paper_id": F.when(hit, F.lit(new)).otherwise(F.col("paper_id")), "hash": F.when(hit, content_hash(paper=F.lit(new), stem=F.col("stem"))).otherwise(F.col("hash"))})


def soft_deletes(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows after delete and restore events; the last event of each row decides, and a restore counts once."""
    last = events.groupBy("id").agg(F.max_by("op", "event_id").alias("op"), F.count_if(F.col("op") == "restore").alias("restores"))
    return rows.join(last, "id", "left").withColumn("deleted", F.coalesce(F.col("op") == "delete", F.lit(False))).drop("op")


def reordered(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions after a page permutation ``(paper_id, page, to_page)``; pages without an entry stay."""
    moved = regions.join(pages, ["paper_id", "page"], "left")
    return moved.withColumn("page", F.coalesce("to_page", "page")).drop("to_page")


def split_check(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether a split takes every page of a paper exactly once."""
    taken = parts.groupBy("paper_id", "page").count()
    both = pages.join(taken, ["paper_id", "page"], "full_outer")
    return both.groupBy("paper_id").agg(F.count_if(F.col("count").isNull()).alias("missing"), F.count_if(F.col("count") > 1).alias("repeated")).withColumn("lossless", (F.col("missing") == 0) & (F.col("repeated") == 0))


def drafts_after(saves: DataFrame) -> DataFrame:
    """Drafts after saves ``(event_id, draft_id, expected, body)``: a save holds only if it names the revision reached.

    In order of events, the save that expects revision k and comes first after
    revision k was reached makes k + 1.
    """
    by = Window.partitionBy("draft_id", "expected").orderBy("event_id")
    first = saves.withColumn("_r", F.row_number().over(by)).where("_r = 1")
    chain = Window.partitionBy("draft_id").orderBy("expected")
    ok = first.withColumns({"_k": F.row_number().over(chain) - 1, "_up": F.max("event_id").over(chain.rowsBetween(Window.unboundedPreceding, -1))})
    good = ok.withColumn("_good", (F.col("_k") == F.col("expected")) & (F.col("_up").isNull() | (F.col("_up") < F.col("event_id"))))
    held = good.withColumn("_all", F.bool_and("_good").over(chain)).where("_all")
    return held.groupBy("draft_id").agg(F.max("expected").alias("_e"), F.max_by("body", "expected").alias("body")).select("draft_id", (F.col("_e") + 1).alias("revision"), "body")


def rejected_before(proposals: DataFrame, rejected: DataFrame) -> DataFrame:
    """Proposals whose change was not rejected before."""
    return proposals.join(rejected.select("change_hash"), "change_hash", "left_anti")
