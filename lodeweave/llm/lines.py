"""Cross-site boilerplate lines by distinct-site spread.

Each line hash gets a HyperLogLog sketch of the sites it occurs on, merged by
aggregation. Lines whose estimate is clearly above the threshold are
boilerplate; those near it get an exact distinct count first. A boilerplate
line stays in the document with the smallest doc_id that has it and goes from
all others, so no text leaves the corpus altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, scratch, without

#: Sites from which a line is boilerplate; shortest line that counts; size of the sketches.
SITES, LEAST_CHARS, LG_K = 8, 12, 12
#: Share of the threshold around it in which counts are made exact: five standard errors of the sketch.
MARGIN = 5 * 1.04 / 2 ** (LG_K / 2)


def _split(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _hashed(docs: DataFrame) -> DataFrame:
    """A row for each line that counts, named by 96 bits of hash."""
    lines = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"), F.col("source").alias("_site"), F.posexplode(_split()).alias("_pos", "_line"))
    line = F.trim("_line")
    return lines.where(F.length(line) >= LEAST_CHARS).select("_id", "_t", "_site", "_pos", F.xxhash64(line).alias("_h"), F.hash(line).alias("_g"))


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``(_h, _g, _first)``: lines on ``sites`` or more sites, and the smallest doc_id that has each."""
    lines = _hashed(docs)
    margin = max(1.0, MARGIN * sites)
    spread = lines.groupBy("_h", "_g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LG_K))).alias("_n"), F.min("_id").alias("_first"))
    wide = cut(spread.where(F.col("_n") >= sites - margin))
    near = wide.where(F.col("_n") <= sites + margin)
    exact = lines.join(near, ["_h", "_g"], "left_semi").where("_site is not null").select("_h", "_g", "_site").distinct().groupBy("_h", "_g").count().where(F.col("count") >= sites)
    return wide.where(F.col("_n") > sites + margin).unionByName(near.join(exact.select("_h", "_g"), ["_h", "_g"], "left_semi")).select("_h", "_g", "_first")


def _dropped(array: Column, places: Column) -> Column:
    """``array`` without its elements at the sorted ``places``: the slices between them, so time grows with the array only."""
    ends = F.concat(F.array(F.lit(-1)), places, F.array(F.size(array)))
    # The arrays of one element name values that the inner functions share.
    slices = lambda x, e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.slice(x, F.get(e, k - 1) + 2, F.get(e, k) - F.get(e, k - 1) - 1))
    return F.get(F.transform(F.array(array), lambda x: F.get(F.transform(F.array(ends), lambda e: F.flatten(slices(x, e))), F.lit(0))), F.lit(0))


def clean_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``, plus ``n_lines`` and ``n_removed``.

    Every row stays, also if nothing of its text is left; a null text stays
    null; lines on rows with a null source count for no site; rows that repeat
    are treated alike; ``n_chars``, where there is one, follows the new text.
    Columns ``n_lines`` and ``n_removed`` are replaced. Lines compare without outer spaces and count from ``LEAST_CHARS``.
    """
    text, of, name, gone, kept = fresh(docs, "hash", "of", "name", "gone", "kept_text")
    with scratch() as stay:
        found = cut(boilerplate(docs, sites))
        stay.append(found)
    hits = _hashed(docs).join(found, ["_h", "_g"]).where(~F.col("_id").eqNullSafe(F.col("_first"))).groupBy("_id", "_t").agg(F.collect_set("_pos").alias(gone)).withColumnsRenamed({"_id": of, "_t": name})
    keyed = docs.withColumn(text, F.xxhash64("text"))
    joined = keyed.join(hits, keyed["doc_id"].eqNullSafe(hits[of]) & (F.col(text) == F.col(name)), "left")
    left = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(_dropped(_split(), F.array_sort(gone)), "\n"))
    out = joined.withColumn(kept, left)
    n = [F.size(_split()).alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).alias("n_removed")]
    replaced = {"text": F.col(kept).alias("text")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.length(kept).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[replaced.get(c, F.col(c)) for c in without(docs, "n_lines", "n_removed")], *n)


#: DuckDB SQL for the query's rows.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents),
long AS (SELECT * FROM lines WHERE length(line) >= {LEAST_CHARS}),
wide AS (SELECT line, min(doc_id) AS first_id FROM long GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
numbered AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
judged AS (
  SELECT n.*, w.line IS NOT NULL AND n.doc_id <> w.first_id AS gone FROM numbered n LEFT JOIN wide w ON trim(n.line) = w.line)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
