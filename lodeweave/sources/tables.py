"""Table sources: Parquet scans with a default soft-delete predicate, duplicates by content hash, chunk plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def active(rows: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    """The default view: rows that are not soft-deleted."""
    return rows.where(F.col(deleted_at).isNull())


def duplicate_sources(papers: DataFrame, uploads: DataFrame) -> DataFrame:
    """For each upload the stored paper of equal content hash and kind with most questions, then smallest id."""
    best = Window.partitionBy("upload_id").orderBy(F.desc("questions"), "paper_id")
    joined = uploads.join(papers, ["sha256", "kind"])
    return joined.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("upload_id", "paper_id")


def chunk_limit(kind: str, most: str, photo: str = "photos"):
    """Pages a chunk may have: photo sets are never cut, other kinds by the limit."""
    return F.when(F.col(kind) == photo, F.lit(1 << 20)).otherwise(F.col(most))


def plan_chunks(documents: DataFrame, total: str = "total_pages", most: str = "max_pages") -> DataFrame:
    """Lossless split of pages 1..total into chunks: ``sequence`` from 1, first and last page."""
    starts = F.sequence(F.lit(1), F.col(total), F.col(most))
    cut = documents.where(F.col(total) > 0).select("*", F.posexplode(starts).alias("_k", "first_page"))
    return cut.select(*documents.columns, (F.col("_k") + 1).alias("sequence"), "first_page", F.least(F.col("first_page") + F.col(most) - 1, F.col(total)).alias("last_page"))


def chunk_coverage(chunks: DataFrame, key: str) -> DataFrame:
    """Gaps and overlaps between neighbouring chunks and against 1..total for each document."""
    order = Window.partitionBy(key).orderBy("sequence")
    seen = chunks.withColumn("_before", F.coalesce(F.lag("last_page").over(order), F.lit(0)))
    step = F.col("first_page") - F.col("_before") - 1
    sums = seen.groupBy(key).agg(
        F.sum(F.when(step > 0, step).otherwise(0)).alias("gap_pages"),
        F.sum(F.when(step < 0, -step).otherwise(0)).alias("overlap_pages"),
        (F.max("total_pages") - F.max("last_page")).alias("missing_at_end"),
    )
    return sums.withColumn("complete", (F.col("gap_pages") == 0) & (F.col("overlap_pages") == 0) & (F.col("missing_at_end") == 0))


def merge_chunks(chunks: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """Blocks of all chunks with their pages in the whole document and one sequence number over it."""
    joined = blocks.join(chunks.select(key, "sequence", "first_page"), [key, "sequence"])
    order = Window.partitionBy(key).orderBy("sequence", "seq")
    return joined.select(key, (F.col("first_page") + F.col("page") - 1).alias("page"), (F.row_number().over(order) - 1).alias("seq"), "text")


def parse_catalogue(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``# heading`` lines and the distinct names below each: (key, heading, name, first position)."""
    order = Window.partitionBy(key).orderBy("pos")
    text = F.trim("line")
    headed = lines.withColumn("_h", F.when(text.startswith("#"), F.trim(F.regexp_replace(text, "^#+", ""))))
    headed = headed.withColumn("heading", F.last("_h", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    names = headed.where(F.col("_h").isNull() & (text != "") & F.col("heading").isNotNull())
    return names.groupBy(key, "heading", text.alias("name")).agg(F.min("pos").alias("pos"))


def outline(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tree of an indented outline: each line's parent is the last line before it of a smaller level.

    The levels of one document's lines so far are held in an array of the last
    position at each level, so one ordered window does it.
    """
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    levelled = lines.where(F.trim("line") != "").withColumn("level", F.least(F.lit(8), F.floor((F.length("line") - F.length(F.ltrim("line"))) / 2)).cast("int"))
    before = [F.max(F.when(F.col("level") == k, F.col("pos"))).over(order) for k in range(8)]
    above = F.greatest(*[F.coalesce(F.when(F.col("level") > k, b), F.lit(-1)) for k, b in enumerate(before)], F.lit(-1))
    return levelled.select(key, "pos", "level", F.trim("line").alias("title"), above.alias("parent"))
