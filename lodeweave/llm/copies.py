"""Near copies: one document of each group of texts that share most of their five-word shingles.

Texts link if their sets of shingles have a Jaccard similarity of 0.8 or more,
judged by the whole sets. Candidates come from two indexes over texts whose
sets differ (equal sets are folded first):

- SimHash fingerprints of the same shingles at four or fewer differing bits, by
  the multi-index tables of ``simhash``;
- since two texts at 0.8 differ in about ten of 64 bits, which no small Hamming
  ball reaches, also ``BANDS`` MinHash keys of ``ROWS`` minima. Texts at 0.8
  share none of them once in three million pairs.

Every member of a bucket is compared with the bucket's leader, a different one
in each band, so a large group becomes one component by a number of pairs that
grows with its size. Buckets that still hold several components compare those
outside their largest one with all others. A pair is written only if sketches
of ``SKETCH`` two-bit minima do not rule it out (at 0.8 they do in one of a
million), and only for the first key that both texts have.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, drop_cut, fresh, scratch
from .components import connected_components

WORDS, BANDS, ROWS = 5, 28, 4
#: Minima of a sketch, of which two bits are kept, and how many may differ: the mean and 4.75 standard deviations at 0.8.
SKETCH = 768
MOST_OFF = int(0.15 * SKETCH + 4.75 * (0.15 * 0.85 * SKETCH) ** 0.5)
#: Shingles hashed to minima at once; bounds memory for very long texts.
BLOCK = 1 << 10
_M, _N = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)
_FACTORS, _TERMS = (np.random.default_rng(42).integers(0, 1 << 64, (2, max(SKETCH, BANDS * ROWS), 1), np.uint64))
_FACTORS = _FACTORS | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _M
    h ^= h >> np.uint64(32)
    h *= _N
    h ^= h >> np.uint64(29)
    return h


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; fewer words are one shingle, none are no shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    n, width = max(1, len(words) - WORDS + 1), min(WORDS, len(words))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mixed(out + hashes[k : n + k])
    return np.unique(out)


def minima(terms: np.ndarray, count: int) -> np.ndarray:
    """The least value of a non-empty set under each of ``count`` hash functions."""
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(terms), BLOCK):
        values = terms[None, at : at + BLOCK] * _FACTORS[:count]
        values += _TERMS[:count]
        np.minimum(least, values.min(1), out=least)
    return least


def band_keys(terms: np.ndarray) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(terms):
        return np.zeros(0, np.int64)
    key = np.arange(BANDS, dtype=np.uint64)
    for least in minima(terms, BANDS * ROWS).reshape(BANDS, ROWS).T:
        key = _mixed(key + least)
    return key.view(np.int64)


def sketch(terms: np.ndarray) -> np.ndarray:
    """Two bits of each minimum: the first ones packed into longs, then the second ones."""
    bits = _mixed(minima(terms, SKETCH)) >> np.uint64(40)
    planes = [np.packbits(((bits >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for k in (0, 1)]
    return np.concatenate(planes)


_SIGNATURE = "struct<set:binary,n:int,keys:array<long>,fp:long>"


def _signature(text: Column) -> Column:
    @F.arrow_udf(_SIGNATURE)
    def signature(texts: pa.Array) -> pa.Array:
        names, sizes, keys, prints = [], [], [], []
        for text in texts.to_pylist():
            terms = shingles(text)
            names.append(xxhash.xxh3_128_digest(terms.tobytes()))
            sizes.append(len(terms))
            keys.append(band_keys(terms))
            prints.append(simhash.fingerprint(text, WORDS))
        prints = np.array(prints, np.uint64).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(prints)], names=["set", "n", "keys", "fp"])

    return signature(text)


def _sets(batches):
    for batch in batches:
        sets = [shingles(x) for x in batch.column(1).to_pylist()]
        sketches = [sketch(s) if len(s) else None for s in sets]
        short = [s.astype(np.uint32).view(np.int32) for s in sets]  # enough to tell the terms of two texts apart
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "terms", "sketch"])


def _enough(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can have a similarity of 0.8."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _plausible(a: str, b: str) -> Column:
    """Whether two sketches do not rule out a similarity of 0.8."""
    longs = SKETCH // 64
    off = lambda k: F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))).bitwiseOR(F.get(a, F.lit(longs + k)).bitwiseXOR(F.get(b, F.lit(longs + k)))))
    return reduce(lambda x, y: x + y, map(off, range(longs))) <= MOST_OFF


def _alike(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those ``pairs(a, b)`` of ``sets(id, terms, sketch)`` whose sets have a similarity of 0.8 or more."""
    x, y = (sets.select(F.col("id").alias(k), F.col("terms").alias(f"t{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    both, shared = F.size("ta") + F.size("tb"), F.size(F.array_intersect("ta", "tb"))
    linked = _enough(F.size("ta"), F.size("tb")) & _plausible("sa", "sb") & (9 * shared >= 4 * both)
    return pairs.join(x, "a").join(y, "b").where(linked).select("a", "b")


def _in_order(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _near_prints(firsts: DataFrame) -> DataFrame:
    """Candidates of the fingerprints' index: each set with the first of its print, and first ones of linked prints."""
    leads = cut(firsts.groupBy("fp").agg(F.min("id").alias("lead")))
    same = firsts.join(leads, "fp").where("id <> lead").select(*_in_order("id", "lead"))
    links = simhash.links(leads.select("fp"))
    x, y = (leads.select(F.col("fp").alias(k), F.col("lead").alias(f"l{k}")) for k in "ab")
    return same.union(links.join(x, "a").join(y, "b").select(*_in_order("la", "lb")))


def groups(firsts: DataFrame, texts: DataFrame) -> DataFrame:
    """``(id, root)`` for those of ``firsts(id, n, keys, fp, one, two)`` that have near copies, a table of its own.

    Sets are distinct; ``texts(one, two, text)`` has the text of each pair of ``one`` and ``two``.
    """
    with scratch() as kept:
        keys = firsts.select("id", "n", F.explode("keys").alias("key"))
        # The leader is the id that comes first once the key has stirred the order.
        leads = keys.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("lead"), F.count("*").alias("size"))
        leads = leads.where("size > 1").select("key", F.col("lead").bitwiseXOR(F.col("key")).alias("lead"))
        members = cut(keys.join(leads, "key").where("id <> lead"))
        pairs = cut(members.select(*_in_order("id", "lead")).union(_near_prints(firsts.where("n > 0"))).distinct())
        wanted = firsts.select("id", "one", "two").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
        once = texts.join(wanted.hint("merge"), ["one", "two"]).dropDuplicates(["one", "two"])
        sets = cut(once.select("id", "text").mapInArrow(_sets, "id long, terms array<int>, sketch array<long>"))
        edges = cut(_alike(sets, pairs))
        found = cut(connected_components(edges).select(F.col("node").alias("id"), "root"))
        rest = cut(_apart(members.join(found, "id", "left").withColumn("root", F.coalesce("root", "id")), sets, firsts))
        more = cut(_alike(sets, rest))
        if not more.isEmpty():
            drop_cut(found)
            found = cut(connected_components(edges.union(more)).select(F.col("node").alias("id"), "root"))
        kept.append(found)
    return found


def _apart(members: DataFrame, sets: DataFrame, firsts: DataFrame) -> DataFrame:
    """Pairs of ``members(key, id, n, root)`` of different components that share a key and are not ruled out."""
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("size"))
    open_ = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", "size").alias("largest")).where("roots > 1").select("key", "largest")
    named = cut(members.select("key", "id", "n", "root").join(open_, "key"))
    side = named.join(sets.select("id", "sketch"), "id").join(firsts.select("id", "keys"), "id")
    x, y = side.where("root <> largest").alias("x"), side.alias("y")
    once = (F.col("y.root") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id"))
    near = (F.col("x.root") != F.col("y.root")) & once & _enough(F.col("x.n"), F.col("y.n")) & _plausible("x.sketch", "y.sketch")
    first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & near & first).select(*_in_order("x.id", "y.id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest doc_id stays.

    Texts are near copies if they share 0.8 or more of their distinct five-word
    shingles, without regard to A-Z or a-z; groups are the components of these
    links. Null texts count as empty, empty texts are copies of each other.
    Null doc_ids come last and equal ones by the row's hash; unlike texts stay
    whatever their ids are; of rows equal in every column one stays. All
    columns are kept, whatever their names; an empty table stays empty.
    """
    columns = [c for c, t in docs.dtypes if "map<" not in t]
    one, two = fresh(docs, "one", "two")
    keyed = docs.withColumns({one: F.xxhash64(*columns), two: F.hash(*columns)})
    named = keyed.select(F.col("doc_id").alias("doc"), F.col(one).alias("one"), F.col(two).alias("two"), "text")
    with scratch() as kept:
        rows = cut(named.select("doc", "one", "two", _signature(F.col("text")).alias("s")).select("doc", "one", "two", "s.*"))
        order = F.struct(F.col("doc").isNull().alias("none"), "doc", "one", "two")
        firsts = rows.groupBy("set").agg(F.min(order).alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp"))
        firsts = cut(firsts.select(F.monotonically_increasing_id().alias("id"), "row", "n", "keys", "fp"))
        found = groups(firsts.select("id", "n", "keys", "fp", "row.one", "row.two"), named.select("one", "two", "text"))
        roots = firsts.select("id", "row").join(found, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("row").alias("row"))
        stay = cut(roots.select(F.col("row.one").alias(one), F.col("row.two").alias(two)))
        kept.append(stay)
    return keyed.join(stay.hint("merge"), [one, two], "left_semi").dropDuplicates([one, two]).select(*docs.columns)
