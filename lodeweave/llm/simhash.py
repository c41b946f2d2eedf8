"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in
at most four bits, then one segment is equal or one of the other two differs in
at most one bit (else there would be 1 + 2 + 2 = 5 differences), so each
fingerprint asks the table for one exact key of the narrow segment and for the
Hamming balls of radius 1 of the two wide ones. Whole distances are verified
inside the join, so a candidate pair is never written out unless it is a link.
Equal fingerprints are folded before the search, so copies cost nothing there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .components import connected_components

#: (first bit, width, radius); the radii plus one sum to one more than the distance.
SEGMENTS = ((0, 18, 0), (18, 23, 1), (41, 23, 1))
DISTANCE = 4
WORDS = 4
SEED = 42
#: Shingles hashed and counted at once; bounds memory for very long texts.
BLOCK = 1 << 17


def fingerprint(text: str | None, width: int = WORDS) -> int:
    """Unsigned SimHash of the shingles of ``width`` words; null and texts without words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        part = words[at : to + width - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = (ends - np.diff(ends, prepend=0)).tolist()
        stops = (ends[min(width, len(part)) - 1 :] - 1).tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs``; ``fp`` is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _keys(fp, balls: bool):
    keys = []
    for k, (first, width, radius) in enumerate(SEGMENTS):
        value = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
        for mask in [0, *(1 << i for i in range(width))] if balls and radius else [0]:
            keys.append(value.bitwiseXOR(F.lit(mask)) + F.lit(k << 40))
    return F.array(*keys)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints ``fp`` at ``distance`` or fewer differing bits (at most 4)."""
    if distance > sum(radius + 1 for _, _, radius in SEGMENTS) - 1:
        raise ValueError("the segments' radii do not cover this distance")
    table = prints.select(F.col("fp").alias("b"), F.explode(_keys(F.col("fp"), False)).alias("key"))
    asks = prints.select(F.col("fp").alias("a"), F.explode(_keys(F.col("fp"), True)).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    asks, table = asks.alias("x"), table.alias("y")
    return asks.join(table, (F.col("x.key") == F.col("y.key")) & near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id of those reachable over links.
    Null texts count as empty, empty texts have fingerprint zero and link like
    any other; rows that repeat repeat in the result; a null doc_id keeps its
    row and takes part only as a member (its component's smallest id may be
    null if it has no other). Columns besides doc_id and text are ignored.
    """
    rows = cut(fingerprints(docs))
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    parts = connected_components(links(firsts.select("fp"), distance))
    firsts = firsts.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    roots = firsts.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = firsts.join(roots, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")
