"""Mixing sources to target weights by capped water-filling.

Targets are the fixed point of sharing a budget by weight with a cap for each
source: sources sorted by cap over weight fill up one after the other, and the
first level that fits the rest is the water level. A source's documents are
taken whole as often as its target allows, and once more for a prefix of them
in a seeded hash order whose size is the rest. The prefix's end is found from
sums over hash buckets and then within a single bucket for each source, so no
task sorts a whole source. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop_cut, fresh, scratch, whole, without

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, 7
#: Rows of a hash bucket on average; most sources for a broadcast of their table.
ROWS, SMALL = 1_000, 10_000


def words(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def _key(seed: int) -> Column:
    """Place of a document in its source's order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``.

    Sources take the weights in turn by code point, null last. The windows
    here run over one row a source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    capped = sums.withColumn("weight", weight).withColumn("cap", epochs * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * share
    filled = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels = capped.withColumn("level", (budget - filled) / F.sum("weight").over(rest))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.first(fits, True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"), (level.isNull()).alias("_full")).withColumn(
        "target", F.when(F.col("_full"), F.lit(float(epochs)) * F.col("source_size")).otherwise(F.col("target"))
    ).drop("_full")


def plan(sized: DataFrame, seed: int = SEED, **rule) -> DataFrame:
    """A row a source: sizes, target, whole repetitions and the last key of the extra one.

    ``sized`` has doc_id, source and size and should be cheap to read often. A
    bucket is named by as many hex digits of the key as keep it at about ``ROWS`` rows.
    """
    digits = max(1, (max(1, sized.count() // ROWS) - 1).bit_length() // 4 + 1)
    goals = targets(sized, **rule).withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))).withColumn("extra", F.col("target") - F.col("times") * F.col("source_size"))
    keyed = sized.withColumn("key", _key(seed)).withColumn("bucket", F.substring("key", 1, digits))
    by_source = Window.partitionBy("source").orderBy("bucket")
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("before", F.sum("n").over(by_source) - F.col("n"))
    ends = sums.alias("b").join(goals.select(F.col("source").alias("_s"), "extra").alias("g"), F.col("source").eqNullSafe(F.col("_s")))
    ends = ends.where("before < extra and extra <= before + n + 0.5 and extra >= 0.5").groupBy("source", "extra").agg(F.max_by(F.struct("bucket", "before"), "before").alias("e")).select(F.col("source").alias("_s"), "extra", F.col("e.bucket").alias("_b"), F.col("e.before").alias("before"))
    inside = keyed.join(ends, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    one = inside.groupBy("_s", "_b", "before", "extra", "key").agg(F.sum("size").alias("size"))
    run = F.sum("size").over(Window.partitionBy("_s").orderBy("key")) + F.col("before")
    last = one.withColumn("mid", run - F.col("size") / 2).groupBy("_s").agg(F.coalesce(F.max(F.when(F.col("mid") <= F.col("extra"), F.col("key"))), F.first("_b")).alias("last_key"))
    return goals.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "times", "last_key")


def mix(docs: DataFrame, sized: DataFrame | None = None, seed: int = SEED, **rule) -> DataFrame:
    """``docs`` plus ``source_size``, ``target`` and ``repeats``, how often the mix takes the row.

    A null text has size 0, a null source is a source, the last one; rows that
    repeat a doc_id share its place in the order; an empty table gives an empty
    one; columns of the result's names are replaced; a document is never taken more than the epochs' cap.
    """
    own, size, target, times, last = fresh(docs, "own", "size", "goal", "times", "last")
    with scratch() as kept:
        if sized is None:
            sized = cut(docs.select("doc_id", "source", words().alias("size")))
        goals = cut(plan(sized, seed, **rule))
        kept.append(goals)
    goals = goals.select(F.col("source").alias(own), F.col("source_size").alias(size), F.col("target").alias(target), F.col("times").alias(times), F.col("last_key").alias(last))
    if goals.count() <= SMALL:
        goals = F.broadcast(goals)
    out = docs.join(goals, docs["source"].eqNullSafe(goals[own]))
    extra = F.coalesce(_key(seed) <= F.col(last), F.lit(False)).cast("long")
    rest = without(docs, "source_size", "target", "repeats")
    return out.select(*rest, F.col(size).alias("source_size"), F.col(target).alias("target"), (F.col(times) + extra).alias("repeats"))


def sample(docs: DataFrame, **rule) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, with all its columns.

    Rows of size 0 are taken as their source's whole repetitions say; null and
    repeated ids, null sources and empty tables as for :func:`mix`.
    """
    sized = cut(docs.select("doc_id", "source", words().alias("size")))
    mixed = mix(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source"), sized, **rule)
    drop_cut(sized)
    return mixed.where("repeats > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")


#: DuckDB SQL for the query's rows.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight,
         {EPOCHS} * source_size AS cap FROM sums),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE} - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
water AS (SELECT min_by(level, cap / weight) FILTER (level * weight <= cap) AS level FROM levels),
goals AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), water.level * weight) AS target FROM levels, water),
repeated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM goals),
runs AS (
  SELECT s.*, sum(size) OVER (PARTITION BY source ORDER BY key) - size / 2.0 AS mid FROM sized s),
ends AS (
  SELECT r.source, max(r.key) AS last_key FROM runs r JOIN repeated g ON r.source IS NOT DISTINCT FROM g.source
  WHERE g.target - g.times * g.source_size >= 0.5 AND r.mid <= g.target - g.times * g.source_size GROUP BY r.source)
SELECT s.doc_id, s.size, g.source_size, g.target,
       CAST(s.size * (g.times + CASE WHEN s.key <= e.last_key THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN repeated g ON s.source IS NOT DISTINCT FROM g.source LEFT JOIN ends e ON s.source IS NOT DISTINCT FROM e.source
"""
