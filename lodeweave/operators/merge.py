"""Merging collections: id maps by natural keys, insert-only unions, subsets that are closed under references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import ordered_groups


def id_map(local: DataFrame, incoming: DataFrame, keys: list[str], prefer: list[Column]) -> DataFrame:
    """``(incoming_id, local_id)``: the best local row of each natural key, null where there is none."""
    best = Window.partitionBy(*keys).orderBy(*prefer)
    one = local.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, F.col("id").alias("local_id"))
    return incoming.select(F.col("id").alias("incoming_id"), *keys).join(one, keys, "left").select("incoming_id", "local_id")


def merge_rows(local: DataFrame, incoming: DataFrame, mapping: DataFrame, fill: list[str]) -> DataFrame:
    """Local rows with blanks of ``fill`` taken from what maps to them, and rows that map to none inserted."""
    mapped = incoming.join(mapping, incoming["id"] == mapping["incoming_id"])
    fresh = mapped.where("local_id is null").select(*local.columns).withColumn("origin", F.lit("inserted"))
    best = Window.partitionBy("local_id").orderBy("incoming_id")
    match = mapped.where("local_id is not null").withColumn("_r", F.row_number().over(best)).where("_r = 1").select("local_id", *[F.col(f).alias(f"_{f}") for f in fill])
    joined = local.join(match, local["id"] == match["local_id"], "left")
    blank = {f: F.coalesce(F.col(f), F.lit("")) == "" for f in fill}
    value = {f: F.when(blank[f] & (F.coalesce(F.col(f"_{f}"), F.lit("")) != ""), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fill}
    filled = reduce(lambda a, b: a | b, [blank[f] & (F.coalesce(F.col(f"_{f}"), F.lit("")) != "") for f in fill])
    kept = joined.select(*[value.get(c, F.col(c)) for c in local.columns], F.when(filled, "filled").otherwise("kept").alias("origin"))
    return kept.unionByName(fresh)


def merge_counts(merged: DataFrame) -> DataFrame:
    """What a merge does or would do: a dry run counts the same plan."""
    return merged.groupBy("origin").agg(F.count("*").alias("rows"))


def undo_merge(rows: DataFrame, record: DataFrame) -> DataFrame:
    """Rows without those that the recorded merge inserted."""
    return rows.join(record.select("id"), "id", "left_anti")


def stem_head(stem: str, n: int = 30) -> Column:
    return F.substring(F.regexp_replace(F.col(stem), r"\s", ""), 1, n)


def match_questions(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming questions of a matched paper: the local one of equal number and head, else of equal head, else none.

    Heads match when one begins the other; the join is on a shorter common
    head, so it stays an equi join, and empty heads match only by number.
    """
    cols = lambda df, p: df.select(F.col("id").alias(f"{p}id"), "paper_id", F.col("number").alias(f"{p}number"), stem_head("stem").alias(f"{p}head"))
    a, b = cols(incoming, "i_"), cols(local, "l_")
    begins = F.col("i_head").startswith(F.col("l_head")) | F.col("l_head").startswith(F.col("i_head"))
    same = a.join(b, (a["paper_id"] == b["paper_id"]) & (F.col("i_number") == F.col("l_number"))).drop(b["paper_id"]).where(begins).withColumn("_s", F.lit(1))
    # One head begins the other: each head of at most 30 characters meets the others by its own beginnings.
    starts = lambda side, k: side.where(F.length(f"{k}_head") > 0).withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.length(f"{k}_head")), lambda n: F.substring(F.col(f"{k}_head"), F.lit(1), n))))
    local_first = starts(a, "i").join(b, (a["paper_id"] == b["paper_id"]) & (F.col("_p") == F.col("l_head"))).select("i_id", "l_id")
    incoming_first = a.join(starts(b, "l"), (a["paper_id"] == b["paper_id"]) & (F.col("i_head") == F.col("_p"))).select("i_id", "l_id")
    twin = local_first.union(incoming_first).distinct().withColumn("_s", F.lit(2))
    best = Window.partitionBy("i_id").orderBy("_s", "l_id")
    hits = same.select("i_id", "l_id", "_s").unionByName(twin).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("i_id", F.col("l_id"), "_s")
    return a.join(hits, "i_id", "left").select(F.col("i_id").alias("id"), F.col("l_id").alias("local_id"), F.when(F.col("_s") == 1, "number").when(F.col("_s") == 2, "stem").otherwise("new").alias("by"))


def closed_subset(tables: dict[str, DataFrame], kept: DataFrame, references: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """The rows that belong to the kept ids of the first table, by a chain of semi joins.

    ``references`` are (table, column, parent table, parent column) in order.
    """
    first = next(iter(tables))
    out = {first: tables[first].join(kept, "id", "left_semi")}
    for table, column, parent, parent_column in references:
        ids = out[parent].select(F.col(parent_column).alias("_k")).distinct()
        rows = out.get(table, tables[table])
        out[table] = rows.join(ids, rows[column] == ids["_k"], "left_semi")
    return out


def exact_cover(parts: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """Whether ``parts`` take each key of ``whole`` exactly once and nothing else."""
    a = parts.groupBy(key).agg(F.count("*").alias("_n"))
    both = a.join(whole.select(key).withColumn("_w", F.lit(1)), key, "full_outer")
    return both.agg(F.count_if(F.col("_w").isNull()).alias("extra"), F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_n") > 1).alias("repeated"))


def match_cards(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """Cards of a new segmentation and the stored ones: by anchor and kind, by anchor, then by number in the group.

    Each pass takes mutual firsts among what is left, so a card is used once.
    """
    passes = [["paper_id", "anchor", "kind"], ["paper_id", "anchor"], ["paper_id", "number"]]
    left, free, out = desired, existing, None
    for k, keys in enumerate(passes):
        # A number tells only where there is no anchor to go by, or the kind is not known.
        asked = left.where("anchor is null or kind in ('unknown', 'manual')") if keys[-1] == "number" else left
        d = asked.where(" and ".join(f"{c} is not null" for c in keys)).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("position")))
        e = free.where(" and ".join(f"{c} is not null" for c in keys)).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("deleted", "id")))
        hit = d.select(*keys, "_n", "position").join(e.select(*keys, "_n", "id"), [*keys, "_n"]).select("paper_id", "position", "id", F.lit(k + 1).alias("pass"))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit.select("paper_id", "position"), ["paper_id", "position"], "left_anti")
        free = free.join(hit.select("id"), "id", "left_anti")
    return out


def _greedy(rows: list) -> list[tuple]:
    """One paper's desired cards in order, each with the stored card that it takes."""
    by_anchor, by_kind, by_number = {}, {}, {}
    out, used = [], set()
    for r in rows:
        group = r.only_group if r.grp is None and r.stored else r.grp
        if r.stored:
            if r.anchor is not None:
                by_anchor.setdefault(r.anchor, []).append((group, r))
                by_kind.setdefault((r.anchor, r.kind), []).append((group, r))
            by_number.setdefault((group, r.number), []).append((group, r))
            continue
        found, book = None, r.kind in ("example", "exercise")
        stages = [("anchor and kind", by_kind.get((r.anchor, r.kind), [])), ("anchor", by_anchor.get(r.anchor, []))] if r.anchor is not None else []
        stages = [(name, [e for g, e in some if book or g == group]) for name, some in stages]
        if r.anchor is None or r.kind in ("unknown", "manual"):
            stages.append(("number", [e for _, e in by_number.get((group, r.number), [])]))
        for name, some in stages:
            free = [e for e in some if e.card not in used]
            if free:
                found = min(free, key=lambda e: (abs(e.place - r.place), e.deleted, e.card))
                used.add(found.card)
                break
        out.append((r.paper_id, r.item, found.card if found else None, name if found else None))
    out += [(r.paper_id, None, r.card, None) for r in rows if r.stored and r.card not in used]
    return out


def matched_cards(existing: DataFrame, desired: DataFrame) -> DataFrame:
    """(paper_id, item, card, by): each desired card in order with the stored one that it takes, then the stored ones left.

    ``existing(paper_id, card, grp, anchor, kind, number, place, deleted)``,
    ``desired(paper_id, item, grp, anchor, kind, number, place)`` in order of
    ``item``. By anchor and kind, then by anchor, in the same group unless it is
    a typed anchor of a textbook, then by number in the group, where there is no
    anchor or its kind says nothing. Of several free cards the nearest by place,
    a live one before a deleted one, the smallest id. A stored card is taken
    once, so what comes first decides: a paper is streamed, not joined. Stored
    cards without a group belong to the only one that a paper desires.
    """
    only = desired.groupBy("paper_id").agg(F.when(F.countDistinct("grp") == 1, F.min("grp")).alias("only_group"))
    old = existing.select("paper_id", F.lit(True).alias("stored"), F.lit(None).cast("long").alias("item"), F.col("card").cast("long").alias("card"), "grp", "anchor", "kind", "number", F.coalesce(F.col("place").cast("double"), F.lit(0.0)).alias("place"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    new = desired.select("paper_id", F.lit(False).alias("stored"), F.col("item").cast("long").alias("item"), F.lit(None).cast("long").alias("card"), "grp", "anchor", "kind", "number", F.coalesce(F.col("place").cast("double"), F.lit(0.0)).alias("place"), F.lit(False).alias("deleted"))
    # ids and keys as text, so that nulls stay nulls on their way
    rows = old.unionByName(new).join(only, "paper_id", "left")
    rows = rows.select("paper_id", "stored", F.col("stored").cast("int").alias("rank"), F.coalesce("item", F.lit(-1)).alias("item"), F.coalesce("card", F.lit(-1)).alias("card"), *[F.col(c).cast("string").alias(c) for c in ("grp", "anchor", "kind", "number", "only_group")], "place", "deleted")
    schema = "paper_id long, item long, card long, by string"
    return ordered_groups(rows.withColumn("rank", 1 - F.col("rank")), "paper_id", ["rank", "item", "card"], _greedy, schema)
