"""Document fingerprints by consistent weighted sampling.

A document is its five-word shingles weighted by how often they occur (fewer
words: the whole sequence). The units of a shingle's weight are dealt to
``BINS`` bins in turn, from a first bin and by an odd step that its hash gives,
so a shingle of weight w stands in min(w, BINS) bins and its weight in each
follows from w: the same for all texts, and all bins get equal shares of a
text's weight. In each bin one sample is drawn over all that the bin holds: for
a weighted shingle, gamma variates r and c and a uniform b come from its hashes;
with t = floor(ln w / r + b) the sample is the shingle of least
ln c - r (t - b + 1), and that least value itself goes into the signature. Two
texts share a bin's value with a probability equal to the generalised Jaccard
similarity of what they have in the bin, so the share of equal values among the
bins that either text uses estimates that of the texts, with less scatter than
as many independent samples, and exactly where no bin holds more than one unit.
Shingles are hashed, sorted and counted within a row; sampling is ordinary
column arithmetic over a row for each shingle and bin and one minimum a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, whole

BINS, SHINGLE = 128, 5
#: Rows of a bucket of neighbouring documents.
ROWS, QUANTILES = 1000, 64


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _terms(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds ``out``, the (term, tf) array of the word hashes in ``words``; each step is a column of its own, so that none is computed twice."""
    w = F.col(words)
    some = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    df = df.withColumn("_h", F.sort_array(F.when(F.size(w) >= SHINGLE, some).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))))
    h = F.col("_h")
    df = df.withColumn("_at", F.when(F.size(h) > 0, F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))).otherwise(F.array().cast("array<int>")))
    at = F.col("_at")
    return df.withColumn(out, F.transform(at, lambda s, j: F.struct(F.get(h, s).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(h)) - s).alias("tf")))).drop("_h", "_at")


def sample(term: Column, place: Column, weight: Column) -> Column:
    """The value that the least of a bin is taken of; ``place`` tells the bins of a term apart."""
    unit = 1.0 / (1 << 32)
    low, high = lambda h: (h.bitwiseAND(F.lit(0xFFFFFFFF)) + 0.5) * unit, lambda h: (F.shiftrightunsigned(h, 32) + 0.5) * unit
    a, c, b = (F.xxhash64(term, place, F.lit(j)) for j in range(3))
    r, beta = -F.log(low(a) * high(a)), high(b)
    t = F.when(weight == 1, F.lit(0.0)).otherwise(F.floor(F.log(weight.cast("double")) / r + beta).cast("double"))  # b is below one
    return F.log(-F.log(low(c) * high(c))) - r * (t - beta + 1)


def bin_of(term: Column, place: Column) -> Column:
    """The bin of a term's unit: its hash gives the first and an odd step, so that ``BINS`` units in a row meet all bins."""
    h = F.xxhash64(term, F.lit("bin"))
    step = F.shiftright(h, 8).bitwiseAND(F.lit(BINS // 2 - 1)) * 2 + 1
    return (h.bitwiseAND(F.lit(BINS - 1)) + place * step).bitwiseAND(F.lit(BINS - 1)).cast("int")


def _bucketed(docs: DataFrame) -> DataFrame:
    """Adds ``_b``, which grows with doc_id and has about ``ROWS`` rows; null ids are below all."""
    got = docs.agg(F.count("doc_id"), F.percentile_approx("doc_id", [k / QUANTILES for k in range(QUANTILES + 1)], 2000)).first()
    bounds = sorted(set(got[1] or [0]))
    parts = max(1, -(-got[0] // (QUANTILES * ROWS)))
    bucket = F.lit(0).cast("long")
    for k, (a, b) in enumerate(zip(bounds, [*bounds[1:], bounds[-1] + 1])):
        inner = F.least(F.lit(parts - 1), F.greatest(F.lit(0), ((F.col("doc_id") - a) / F.lit(float(b - a)) * parts).cast("long")))
        bucket = F.when(F.col("doc_id") >= a, 1 + k * parts + inner).otherwise(bucket)
    return docs.withColumn("_b", F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(bucket))


def with_next(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, text, _b, _r)`` plus the next document's text and its ``(_nb, _nr)``, by descending doc_id; and the cut table they read.

    The last document's next is the first. Equal doc_ids follow each other by
    the hash of their texts. A bucket's last row takes the first row of the
    next bucket, found by id, so no window spans the table.
    """
    rows = _bucketed(docs.select(F.col("doc_id").cast("long"), whole().alias("text"))).withColumn("_h", F.bitwise_not(F.xxhash64("text")))
    order = Window.partitionBy("_b").orderBy(F.col("doc_id").desc_nulls_last(), F.col("_h").desc())
    led = rows.withColumns({"_r": F.row_number().over(order), "_next": F.lead("text").over(order)})
    firsts = rows.groupBy("_b").agg(F.max(F.struct("doc_id", "_h")).alias("_f"))
    down = Window.orderBy(F.col("_b").desc())
    every = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = firsts.select("_b", F.coalesce(F.lead("_f").over(down), F.first("_f").over(every)).alias("_f"), F.coalesce(F.lead("_b").over(down), F.first("_b").over(every)).alias("_nb"))
    heads = turn.select(F.col("_b").alias("_of"), "_nb", F.col("_f.doc_id").alias("_id"), F.col("_f._h").alias("_hh"))
    heads = cut(heads)
    named = rows.select("doc_id", "text", "_h").join(_small(heads), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hh")))
    named = named.select("_of", "_nb", F.col("text").alias("_head")).dropDuplicates(["_of"])
    out = led.join(named, (F.col("_b") == F.col("_of")) & F.col("_next").isNull(), "left")
    last = F.col("_next").isNull()
    out = out.select(
        "doc_id", "text", "_b", "_r", F.coalesce("_next", "_head").alias("next_text"),
        F.when(last, F.col("_nb")).otherwise(F.col("_b")).alias("_nb"), F.when(last, F.lit(1)).otherwise(F.col("_r") + 1).alias("_nr"),
    )
    return out, heads


def _small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Broadcast where the counted rows are few (ids and hashes only)."""
    return F.broadcast(df) if df.count() <= most else df


def signatures(rows: DataFrame, texts: list[str], keys: list[str]) -> DataFrame:
    """``keys`` plus one signature for each text column, named ``sig0``, ``sig1``...

    A signature is an ``array<int>`` with ``bin << 16 | hash of the least value``
    for each bin that the text uses, empty for a text without words. ``keys``
    name a row. Rows that are already dealt out by one of ``keys`` are not
    shuffled again.
    """
    at = rows
    for k, text in enumerate(texts):
        at = at.withColumn(f"_w{k}", word_hashes(F.col(text)))
    at = at.drop(*[t for t in texts if t not in keys])
    for k in range(len(texts)):
        at = _terms(at, f"_w{k}", f"_t{k}").drop(f"_w{k}")
    nothing = F.array(F.struct(F.lit(0).alias("which"), F.lit(None).cast("long").alias("term"), F.lit(0).alias("place"), F.lit(1).alias("weight")))  # keeps rows without words
    each = at.select(*keys, F.inline(F.concat(nothing, *[F.flatten(F.transform(f"_t{k}", _dealt(k))) for k in range(len(texts))])))
    value = F.when(F.col("term").isNotNull(), sample(F.col("term"), F.col("place"), F.col("weight")))
    least = each.select(*keys, "which", bin_of(F.col("term"), F.col("place")).alias("bin"), value.alias("v")).groupBy(*keys, "which", "bin").agg(F.min("v").alias("v"))
    code = F.when(F.col("v").isNotNull(), F.shiftleft("bin", 16).bitwiseOR(F.hash("v").bitwiseAND(F.lit(0xFFFF))))
    return least.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(F.col("which") == k, code))).alias(f"sig{k}") for k in range(len(texts))])


def _dealt(which: int):
    """The bins' shares of a term's weight: bin after bin of its turn gets one unit, until all are dealt."""

    def shares(x: Column) -> Column:
        weight = lambda k: (F.call_function("div", x["tf"] - 1 - k, F.lit(BINS)) + 1).cast("int")
        return F.transform(F.sequence(F.lit(0), F.least(x["tf"], F.lit(BINS)) - 1), lambda k: F.struct(F.lit(which).alias("which"), x["term"].alias("term"), k.alias("place"), weight(k).alias("weight")))

    return shares


def likeness(a: str, b: str) -> Column:
    """Share of equal values among the bins that either signature uses; 1 for two empty ones."""
    bins = lambda x: F.transform(x, lambda c: F.shiftright(c, 16))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / used)


def as_text(sig: str) -> Column:
    """Two hex digits for the bin and four for its value, bin after bin."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 6, "0"))), "")


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row's text and of its edited text, and their likenesses.

    Null texts count as empty, null doc_ids come last in the descending order,
    rows that repeat stay and follow each other. A single row is its own next.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows, heads = with_next(docs)
    rows = rows.withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("next_text")
    sigs = cut(signatures(rows, ["text", "edited"], ["_b", "_r", "doc_id", "n_chars", "edited_sha256", "_nb", "_nr"]))
    drop_cut(heads)
    after = sigs.select(F.col("_b").alias("_nb"), F.col("_r").alias("_nr"), F.col("sig0").alias("_after"))
    return sigs.join(after, ["_nb", "_nr"]).select(
        "doc_id", "n_chars", "edited_sha256", as_text("sig0").alias("fingerprint"), as_text("sig1").alias("edited_fingerprint"),
        likeness("sig0", "sig1").alias("near_edited"), likeness("sig0", "_after").alias("near_next"),
    )
