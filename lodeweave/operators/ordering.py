"""Total orders, pages, resolution of ids, and version histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE, MOST_PAGE = 40, 1000


def order(name: str) -> list[Column]:
    """A named total order; ids break ties and nulls stand last."""
    recent = [F.desc("published_at"), F.desc("id")]
    orders = {
        "recent": recent,
        "source": [F.asc_nulls_last("paper_id"), F.asc_nulls_last("number"), F.asc("id")],
        "number": [F.asc_nulls_last("number"), F.asc_nulls_last("paper_id"), F.asc("id")],
        "display": [F.asc_nulls_last("kind"), *recent],
    }
    return orders[name]


def page(rows: DataFrame, by: str = "recent", offset: int = 0, limit: int = PAGE) -> DataFrame:
    """One page in a named order, with its positions.

    A sort with a limit is a top-k over partitions; the row that is asked for
    beyond the page tells whether more follow.
    """
    limit = max(1, min(limit, MOST_PAGE))
    top = rows.orderBy(*order(by)).limit(offset + limit + 1)
    placed = top.withColumn("position", F.row_number().over(Window.orderBy(*order(by))) - 1)
    more = F.max("position").over(Window.partitionBy(F.lit(0))) >= offset + limit
    return placed.withColumn("has_more", more).where((F.col("position") >= offset) & (F.col("position") < offset + limit))


def latest(rows: DataFrame, key: str = "question_id") -> DataFrame:
    """The newest version of each record."""
    newest = Window.partitionBy(key).orderBy(F.desc("version"), F.desc("published_at"), F.desc("id"))
    return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def resolve(requested: DataFrame, pubs: DataFrame) -> DataFrame:
    """Requested ids ``(position, id)`` in order with what became of each.

    Published rows are available; others say withdrawn, superseded or
    not_found. A superseded row names the newest published version of its
    question as replacement, which is never put in its place.
    """
    found = requested.join(pubs.select("id", "question_id", "status"), "id", "left")
    newest = latest(pubs.where("status = 'published'")).select("question_id", F.col("id").alias("replacement_id"))
    out = found.join(newest, "question_id", "left")
    reason = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "published", F.col("status"))
    return out.select("position", "id", (F.coalesce("status", F.lit("")) == "published").alias("available"), reason.alias("reason"), F.when(F.col("status") == "superseded", F.col("replacement_id")).alias("replacement_id"))


def history(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each version with the fields that differ from the version before; null keys are histories of their own."""
    versions = Window.partitionBy(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("#"), F.col("id").cast("string")))).orderBy("version")
    changed = F.array_compact(F.array(*[F.when(~F.lag(f).over(versions).eqNullSafe(F.col(f)), F.lit(f)) for f in fields]))
    first = F.row_number().over(versions) == 1
    return rows.withColumn("changed", F.when(first, F.array().cast("array<string>")).otherwise(changed))


def natural_order(files: DataFrame) -> DataFrame:
    """Files of a set by capture time, then the number in their name, then as selected."""
    number = F.regexp_extract("name", r"(\d+)", 1)
    by = Window.partitionBy("set_id").orderBy(F.asc_nulls_last("taken"), F.when(number != "", number.cast("long")).asc_nulls_last(), "selected")
    return files.withColumn("place", F.row_number().over(by))


def arranged(pages: DataFrame) -> DataFrame:
    """Pages by their printed ranges; a set in which ranges overlap keeps its order."""
    by = Window.partitionBy("set_id").orderBy("lo", "selected")
    placed = pages.withColumns({"_p": F.row_number().over(by), "_o": F.coalesce(F.lag("hi").over(by) >= F.col("lo"), F.lit(False))})
    clash = F.bool_or("_o").over(Window.partitionBy("set_id"))
    kept = F.row_number().over(Window.partitionBy("set_id").orderBy("selected"))
    return placed.withColumn("refused", clash).withColumn("place", F.when(F.col("refused"), kept).otherwise(F.col("_p"))).drop("_p", "_o")


def reading_order(blocks: DataFrame, split: str = "split_x") -> DataFrame:
    """Blocks by page, column and height."""
    column = (F.col("x0") >= F.col(split)).cast("int")
    by = Window.partitionBy("paper_id").orderBy("page", column, "y0", "x0", "seq")
    return blocks.withColumns({"column": column, "place": F.row_number().over(by)})


def grouped_order(items: DataFrame, types: list[str]) -> DataFrame:
    """Items grouped by type in the order of ``types``, then as captured."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in types]), F.col("kind")), F.lit(0))
    rank = F.when(rank == 0, len(types) + 1).otherwise(rank)
    return items.withColumn("place", F.row_number().over(Window.partitionBy("draft_id").orderBy(rank, "position")))


def slim(rows: DataFrame, drop: list[str]) -> DataFrame:
    """List rows without their heavy columns."""
    return rows.drop(*drop)


def snippet(text: str, most: int = 92) -> Column:
    """First line, cut to ``most`` characters with an ellipsis."""
    one = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).otherwise(one)


def with_tags(rows: DataFrame, assignments: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows with the names of their confirmed tags as a sorted array, and framed for exact search."""
    names = assignments.where("not needs_review").join(tags, "tag_id").groupBy(F.col("publication_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("tags"))
    out = rows.join(names, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return out.withColumn("tags_text", F.when(F.size("tags") > 0, F.concat(F.lit("|"), F.array_join("tags", "|"), F.lit("|"))).otherwise(""))
