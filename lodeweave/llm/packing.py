"""Packing documents into fixed sequences by cutting-stock column generation.

A document of n tokens is cut into full sequences and a rest. Rests are items
of a cutting-stock problem over a histogram of length classes: a linear
program over patterns, whose columns are priced by a knapsack dynamic program,
is solved on the driver from that histogram (at most ``CLASSES`` counts),
patterns are rounded down and what is left is packed first-fit decreasing.
Ranked documents of a class then take the slots of the patterns. The gaps that
stay (lengths within a class differ) are filled with pieces cut from full
sequences, laid on one line against each other by prefix sums. What remains of
the last one goes to sequences of powers of two, which need no padding.

Ranks and prefix sums come from counts over hash buckets, never from one sort
of all rows. Token ids are kept only for documents that are cut.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LENGTH, CLASSES, END = 2048, 128, 1
WIDTH = LENGTH // CLASSES
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Rows of a bucket within which a window ranks or adds up.
ROWS = 2_000


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def _encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, path: str | None = None) -> np.ndarray:
    """Ids of the 50k byte-level vocabulary and the end id; the special token's string is that token."""
    encoder, parts = _encoder(path or vocabulary()), (text or "").split(SPECIAL)
    out = []
    for k, part in enumerate(parts):
        if k:
            out.append([SPECIAL_ID])
        out.append(encoder.encode_ordinary(part))
    out.append([END])
    return np.concatenate([np.asarray(x, np.uint32) for x in out])


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenized(batches):
    names = ["doc_id", "n", "crc", "ids"]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = token_ids(text)
            whole = len(ids) < LENGTH
            rows.append((doc, len(ids), crc(ids) if whole else None, None if whole else ids.astype("<u2").tobytes()))
            if len(rows) == 2000:
                yield _batch(rows, names)
                rows = []
        if rows:
            yield _batch(rows, names)


def _batch(rows, names):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)


# The plan, on the driver.


def _knapsack(values: np.ndarray) -> tuple[float, np.ndarray]:
    """Most value of classes 1..CLASSES (their sizes) in CLASSES units, and how often each is taken."""
    best, pick = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1, int)
    for room in range(1, CLASSES + 1):
        gains = values[:room] + best[room - 1 :: -1][:room]
        k = int(gains.argmax())
        best[room], pick[room] = (gains[k], k + 1) if gains[k] > best[room - 1] + 1e-12 else (best[room - 1], 0)
    taken, room = np.zeros(len(values), int), CLASSES
    while room > 0:
        if pick[room]:
            taken[pick[room] - 1] += 1
            room -= pick[room]
        else:
            room -= 1
    return float(best[CLASSES]), taken


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan steps with row pivots, without BLAS."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        p = k + int(np.abs(work[k:, k]).argmax())
        work[[k, p]] = work[[p, k]]
        work[k] /= work[k, k]
        rest = np.arange(n) != k
        work[rest] -= np.outer(work[rest, k], work[k])
    return work[:, n:]


def cutting_stock(demand: np.ndarray, most_columns: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns (count of each class) and how many sequences take each, covering ``demand``.

    Column generation from single-class patterns; if the program is not solved
    to the end after ``most_columns`` columns its last solution is rounded.
    """
    demand = np.asarray(demand, np.int64)
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    sizes = used + 1
    basis = np.zeros((len(used), len(used)))
    basis[np.arange(len(used)), np.arange(len(used))] = CLASSES // sizes
    asked = demand[used] + 1e-4 * (1 + np.arange(len(used))) / len(used)  # apart, so that no two rows tie for long
    x = asked / np.diag(basis)
    inverse = np.diag(1 / np.diag(basis))
    for step in range(most_columns):
        price = inverse.sum(0)
        full = np.zeros(CLASSES)
        full[used] = price
        value, taken = _knapsack(np.maximum(full, 0))
        if value <= 1 + 1e-9:
            break
        column = taken[used].astype(float)
        direction = np.einsum("ij,j->i", inverse, column)  # small: not worth BLAS threads
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratios.argmin())
        if not np.isfinite(ratios[leave]):
            break
        basis[:, leave] = column
        inverse[leave] /= direction[leave]
        others = np.arange(len(used)) != leave
        inverse[others] -= np.outer(direction[others], inverse[leave])
        if step % 500 == 499:
            inverse = _inverse(basis)
        x = np.maximum(np.einsum("ij,j->i", inverse, asked), 0)
    plan, left = [], demand.copy()
    for k, times in enumerate(np.floor(x).astype(np.int64)):
        pattern = np.zeros(CLASSES, np.int64)
        pattern[used] = np.rint(basis[:, k]).astype(np.int64)
        if times > 0:
            plan.append((pattern, int(times)))
            left -= pattern * times
    left = np.maximum(left, 0)
    while left.any():  # first-fit decreasing, a whole run of equal sequences at a time
        pattern, room = np.zeros(CLASSES, np.int64), CLASSES
        for c in np.flatnonzero(left)[::-1]:
            pattern[c] = min(left[c], room // (c + 1))
            room -= pattern[c] * (c + 1)
        on = pattern > 0
        times = int((left[on] // pattern[on]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def _slots(plan) -> tuple[list, int]:
    """For each class its slots in order: (first rank, first sequence, slots a sequence); and all sequences."""
    by_class: list = [[] for _ in range(CLASSES)]
    ranks, base = [0] * CLASSES, 0
    for pattern, times in plan:
        for c in np.flatnonzero(pattern):
            by_class[c].append((ranks[c], base, int(pattern[c])))
            ranks[c] += int(pattern[c]) * times
        base += times
    return [np.array(x, np.int64).reshape(-1, 3) for x in by_class], base


# Distributed ranks and prefix sums.


def _prefix(rows: DataFrame, group: list[str], bucket: str, order: list, amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over all rows of the group before this one, by ``bucket``, then ``order``."""
    sums = rows.groupBy(*group, bucket).agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket)
    sums = sums.withColumn("_before", F.sum("_sum").over(before) - F.col("_sum")).drop("_sum")
    inside = F.sum(amount).over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)
    return rows.withColumn("_inside", inside).join(sums, [*group, bucket]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def pack(docs: DataFrame) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of all rows' tokens.

    A null text counts as empty: one end id. Rows that repeat, also with equal
    or null doc_ids, are packed each; an empty table gives no pieces; other
    columns are ignored. A document's rest is one piece; its full sequences
    are one piece each, but for those that fill gaps.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenized, "doc_id long, n long, crc long, ids binary").withColumn("uid", F.monotonically_increasing_id()))
    narrow = rows.select("uid", "doc_id", "n", "crc", F.floor(F.col("n") / LENGTH).cast("long").alias("full"), (F.col("n") % LENGTH).alias("rest"))
    counts = narrow.groupBy("rest").agg(F.count("*").alias("c"), F.sum("full").alias("f"), F.sum(F.when(F.col("full") > 0, 1).otherwise(0)).alias("long")).collect()
    demand, full, total = np.zeros(CLASSES, np.int64), sum(r["f"] for r in counts), sum(r["c"] for r in counts)
    for r in counts:
        if r["rest"]:
            demand[(r["rest"] - 1) // WIDTH] += r["c"]
    slots, sequences = _slots(cutting_stock(demand))
    buckets = max(1, total // ROWS)

    @F.arrow_udf("long")
    def sequence_of(kind: pa.Array, rank: pa.Array) -> pa.Array:
        k, r = kind.to_numpy(), rank.to_numpy()
        out = np.zeros(len(k), np.int64)
        for c in np.unique(k):
            at = np.flatnonzero(k == c)
            table = slots[c]
            i = np.searchsorted(table[:, 0], r[at], "right") - 1
            out[at] = table[i, 1] + (r[at] - table[i, 0]) // table[i, 2]
        return pa.array(out)

    items = narrow.where("rest > 0").withColumns({"kind": F.floor((F.col("rest") - 1) / WIDTH).cast("int"), "bucket": F.pmod(F.xxhash64("uid"), F.lit(buckets)), "one": F.lit(1).cast("long")})
    ranked = _prefix(items, ["kind"], "bucket", ["uid"], "one", "rank")
    placed = ranked.withColumn("sequence_id", sequence_of("kind", "rank"))
    inside = Window.partitionBy("sequence_id").orderBy("uid")
    rests = cut(placed.select("uid", "doc_id", "n", "crc", (F.col("full") * LENGTH).alias("start"), F.col("rest").alias("length"), "sequence_id", (F.sum("rest").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rest")).alias("offset")))

    used = rests.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumns({"gap": LENGTH - F.col("used"), "bucket": F.floor(F.col("sequence_id") / ROWS).cast("long"), "all": F.lit(1)})
    gaps = cut(used.where("gap > 0"))
    wanted = gaps.agg(F.sum("gap")).first()[0] or 0
    fillers = min(full, -(-wanted // LENGTH))
    line = _prefix(gaps, ["all"], "bucket", ["sequence_id"], "gap", "at").where(F.col("at") < fillers * LENGTH)
    end = F.least(F.col("at") + F.col("gap"), F.lit(fillers * LENGTH))
    first = F.floor(F.col("at") / LENGTH).cast("long")
    spans = line.select("sequence_id", "used", "at", end.alias("end"), F.explode(F.sequence(first, F.floor((end - 1) / LENGTH).cast("long"))).alias("chunk"))
    low, high = F.greatest(F.col("at"), F.col("chunk") * LENGTH), F.least(F.col("end"), (F.col("chunk") + 1) * LENGTH)
    fills = spans.select("chunk", (low - F.col("chunk") * LENGTH).alias("from"), (high - low).alias("length"), "sequence_id", (F.col("used") + low - F.col("at")).alias("offset"))

    chunks = _prefix(narrow.where("full > 0").withColumns({"bucket": F.pmod(F.xxhash64("uid"), F.lit(buckets)), "all": F.lit(1)}), ["all"], "bucket", ["uid"], "full", "first")
    chunks = chunks.select("uid", "doc_id", "n", "first", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("full") - 1)).alias("k", "chunk"))
    chunks = chunks.withColumn("start", F.col("k").cast("long") * LENGTH)
    alone = chunks.where(F.col("chunk") >= fillers).select("uid", "doc_id", "n", "start", F.lit(LENGTH).cast("long").alias("length"), (F.col("chunk") - fillers + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    fed = chunks.where(F.col("chunk") < fillers).join(fills, "chunk").select("uid", "doc_id", "n", (F.col("start") + F.col("from")).alias("start"), "length", "sequence_id", "offset")
    pieces = alone.unionByName(fed)
    left, tail = fillers * LENGTH - wanted, []
    at, nth = LENGTH - left, sequences + full - fillers
    while left > 0 and fillers:
        size = 1 << (left.bit_length() - 1)
        tail.append(F.struct(F.lit(at).cast("long").alias("from"), F.lit(size).cast("long").alias("length"), F.lit(nth).cast("long").alias("sequence_id")))
        at, nth, left = at + size, nth + 1, left - size
    if tail:
        last = chunks.where(F.col("chunk") == fillers - 1).select("uid", "doc_id", "n", "start", F.inline(F.array(*tail)))
        pieces = pieces.unionByName(last.select("uid", "doc_id", "n", (F.col("start") + F.col("from")).alias("start"), "length", "sequence_id", F.lit(0).cast("long").alias("offset")))

    whole = rests.where("start = 0").select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    parts = rests.where("start > 0").drop("crc").unionByName(pieces)
    by_doc = parts.groupBy("uid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    long = rows.where("ids is not null").select("uid", "doc_id", "n", "ids").join(by_doc, "uid")
    return whole.unionByName(long.select("doc_id", "n", "ids", "pieces").mapInArrow(_checked, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))


def _checked(batches):
    """The pieces of documents with their ids' checksums."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        rows = []
        for doc, n, ids, pieces in zip(*(batch.column(k).to_pylist() for k in range(4))):
            ids = np.frombuffer(ids, "<u2")
            for p in sorted(pieces, key=lambda p: p["start"]):
                a, k = p["start"], p["length"]
                rows.append((doc, a, k, crc(ids[a : a + k]), n, p["sequence_id"], p["offset"]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=names)
