"""Long repeated byte strings, with a run-length Burrows-Wheeler index for the hard part.

Every window of ``LENGTH`` bytes is named by its minimizer (the k-gram of least
hash in it), so equal windows have equal minimizers. Neighbouring windows with
one minimizer form a run of bytes, the unit that is shuffled: one row for about
forty windows. Runs that are equal as a whole repeat all their windows, and only
the first stays a candidate; a map task does this for its own rows first, so a
much copied run costs each task one row. Different runs with one minimizer
share some windows at most. Their bytes go to shards, each of which builds a
suffix order, its Burrows-Wheeler transform in runs with the suffix sampled at
each run's head, and streams the match lengths of all positions from these
samples (a position inside a run matches one byte less than the one before it).
Positions matching ``LENGTH`` bytes or more fall into classes of equal windows,
of which the first occurrence stays and the others are marked.

Minimizers with more than ``CROWD`` different runs (a very common passage in as
many contexts) would crowd a shard. Their windows are named by hashes of their
bytes instead and resolved like runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, scratch, whole, without

LENGTH, GRAM = 100, 20
SPAN = LENGTH - GRAM + 1
#: Bytes of text handled at once; at most 2**24, as positions take 24 bits of a packed minimum.
BLOCK = 1 << 21
#: Runs of a shard, and different runs of one minimizer beyond which they don't go to a shard.
SHARD, CROWD = 5_000, 15_000
LAST = (1 << 63) - 1

_RUNS = "a long, s long, doc long, h int, start long, len int, gone boolean"
_NAMES = ["a", "s", "doc", "h", "start", "len", "gone"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()]


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position; positions too near the end get none."""
    n = len(data) - GRAM + 1
    load = lambda at: np.ndarray((n,), "<u8", data, at, (1,))
    h = load(0) * np.uint64(0x9E3779B185EBCA87)
    h ^= h >> np.uint64(32)
    h += load(8)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += load(GRAM - 8)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` consecutive values at each start, from prefix and suffix minima of blocks."""
    n = len(values)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    so_far = np.minimum.accumulate(table, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], so_far[width - 1 : n])


def _block_runs(parts: list[tuple[int, int, int, bytes]]):
    """Runs of a block of ``(doc, h, first, bytes)``: arrays a, s, part, start in the part, len."""
    blob = b"".join(p[3] for p in parts) + bytes(GRAM)
    data = np.frombuffer(blob, np.uint8)
    sizes = np.array([len(p[3]) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    hashes = _gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    least = _window_minima((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), SPAN)
    n = int(ends[-1])
    valid = np.zeros(n + 1, np.int8)
    big = sizes >= LENGTH
    np.add.at(valid, (ends - sizes)[big], 1)
    np.add.at(valid, (ends - LENGTH + 1)[big], -1)
    at = np.flatnonzero(np.cumsum(valid[:n]))
    if not len(at):
        return None
    m = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    first = at[heads]
    last = at[np.append(heads[1:], len(at)) - 1]
    a = hashes[(m[heads] & low).astype(np.int64)].view(np.int64)
    digest = xxhash.xxh3_64_intdigest
    s = np.array([digest(blob[i:j]) for i, j in zip(first.tolist(), (last + LENGTH).tolist())], np.uint64).view(np.int64)
    part = np.searchsorted(ends, first, "right")
    return a, s, part, first - (ends - sizes)[part], last - first + LENGTH


def _firsts(a, s, doc, h, start, length):
    """Rows of a block: the first of equal (a, s) as candidates, the others as merged ranges that are gone."""
    order = np.lexsort((start, h, doc, s, a))
    again = np.zeros(len(order), bool)
    again[1:] = (a[order][1:] == a[order][:-1]) & (s[order][1:] == s[order][:-1])
    keep = order[~again]
    yield _rows(a[keep], s[keep], doc[keep], h[keep], start[keep], length[keep], np.zeros(len(keep), bool))
    gone = order[again]
    if len(gone):
        gone = gone[np.lexsort((start[gone], h[gone], doc[gone]))]
        d, hh, b, e = doc[gone], h[gone], start[gone], start[gone] + length[gone]
        new = np.ones(len(gone), bool)
        new[1:] = (d[1:] != d[:-1]) | (hh[1:] != hh[:-1]) | (b[1:] > e[:-1])
        heads = np.flatnonzero(new)
        stops = np.maximum.reduceat(e, heads)
        mixed = (d[heads] * np.int64(0x9E3779B1) + b[heads]) ^ (hh[heads].astype(np.int64) << 20)
        yield _rows(mixed, mixed, d[heads], hh[heads], b[heads], stops - b[heads], np.ones(len(heads), bool))


def _runs(batches):
    """Map side: runs of all windows of ``(doc, h, text)``."""
    parts, size = [], 0

    def flush():
        found = _block_runs(parts)
        if found is not None:
            a, s, part, start, length = found
            doc, h, first = (np.array([p[k] for p in parts], np.int64)[part] for k in range(3))
            yield from _firsts(a, s, doc, h.astype(np.int32), start + first, length)

    for batch in batches:
        for doc, h, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            data = text.encode("utf-8", "surrogatepass")
            for first in range(0, max(1, len(data) - LENGTH + 1), BLOCK):
                piece = data[first : first + BLOCK + LENGTH - 1]
                if len(piece) < LENGTH:
                    continue
                parts.append((doc, h, first, piece))
                size += len(piece)
                if size >= BLOCK:
                    yield from flush()
                    parts, size = [], 0
    if parts:
        yield from flush()


def _bytes_of_runs(batches):
    """``(doc, h, text, runs)`` to one row for each run with its bytes."""
    for batch in batches:
        out: list = [[], [], [], [], []]
        for doc, h, text, runs in zip(*(batch.column(k).to_pylist() for k in range(4))):
            data = text.encode("utf-8", "surrogatepass")
            for r in runs:
                for column, value in zip(out, (r["a"], doc, h, r["start"], data[r["start"] : r["start"] + r["len"]])):
                    column.append(value)
            if len(out[0]) > 50_000:
                yield _runs_batch(out)
                out = [[], [], [], [], []]
        if out[0]:
            yield _runs_batch(out)


def _runs_batch(out):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["a", "doc", "h", "start", "bytes"])


def _windows(batches):
    """Runs with their bytes to windows, each named by two hashes of its bytes."""
    one, two = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
    for batch in batches:
        doc, h, start, length, a, s = [], [], [], [], [], []

        def flush(doc=doc, h=h, start=start, length=length, a=a, s=s):
            yield from _firsts(np.array(a, np.uint64).view(np.int64), np.array(s, np.uint64).view(np.int64), np.array(doc, np.int64), np.array(h, np.int32), np.array(start, np.int64), np.array(length, np.int64))
            for x in (doc, h, start, length, a, s):
                x.clear()

        for d, hh, at, data in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            for i in range(len(data) - LENGTH + 1):
                window = data[i : i + LENGTH]
                a.append(one(window))
                s.append(two(window))
                doc.append(d)
                h.append(hh)
                start.append(at + i)
                length.append(LENGTH)
            if len(a) > 300_000:
                yield from flush()
        if a:
            yield from flush()


# The run-length index of a shard.


class RunIndex:
    """Run-length Burrows-Wheeler index over byte strings shorter than 256 bytes, each with an end of its own.

    ``order`` is the suffix order, ``heads`` the places in it where a run of the
    transform begins, ``samples`` the suffixes there. ``lengths`` streams, for
    every text position, how much it shares with the suffix before it in order.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(x) for x in strings], np.int64)
        if len(sizes) and sizes.max() > 255:
            raise ValueError("strings of this index have at most 255 bytes")
        self.text = np.frombuffer(b"\0".join(strings) + bytes(272), np.uint8)
        self.n = int(sizes.sum() + len(sizes))
        ends = np.cumsum(sizes + 1) - 1
        self.string = np.repeat(np.arange(len(strings)), sizes + 1)
        self.left = ends[self.string] - np.arange(self.n)  # bytes up to the string's end
        self.order = self._suffix_order()
        before = np.where(self.order > 0, self.order - 1, self.n - 1)
        letter = np.where(self.left[before] == 0, -1 - before, self.text[before].astype(np.int64))  # ends differ from each other
        new = np.ones(self.n, bool)
        new[1:] = letter[1:] != letter[:-1]
        self.heads = np.flatnonzero(new)
        self.samples = self.order[self.heads]

    def _suffix_order(self) -> np.ndarray:
        """By doubling prefixes from seven bytes; only suffixes that still tie are sorted again.

        A rank is the place where its group begins, so it holds while other
        groups are split. Suffixes that end together stand in text order.
        """
        n = self.n
        key = np.zeros(n, np.uint64)
        for k in range(7):
            key <<= np.uint64(8)
            key |= np.where(self.left > k, self.text[k : k + n], 0).astype(np.uint64)
        key <<= np.uint64(8)
        key |= np.minimum(self.left, 7).astype(np.uint64)  # a shorter suffix stands before one with zero bytes
        at = np.argsort(key)
        rank = np.zeros(n, np.int64)
        rank[at], tied = self._split(key[at], np.zeros(n, np.int64))
        width = 7
        at = at[tied]
        while width < 256:
            at = at[self.left[at] > width]
            if not len(at):
                break
            key = (rank[at].astype(np.uint64) << np.uint64(32)) | (rank[at + width] + 1).astype(np.uint64)
            by = np.argsort(key)
            at, key = at[by], key[by]
            # Members of a group that ended here sort before the others of it.
            group = rank[at]
            first = np.ones(len(at), bool)
            first[1:] = group[1:] != group[:-1]
            heads = np.flatnonzero(first)
            sizes = np.diff(np.append(heads, len(at)))
            full = self._group_sizes(rank, group[heads])
            base = np.repeat(group[heads] + full - sizes, sizes) - np.repeat(heads, sizes)
            rank[at], tied = self._split(key, base)
            at = at[tied]
            width *= 2
        return np.argsort((rank.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64))

    @staticmethod
    def _split(key: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of sorted keys (base plus the place where equal ones begin), and whether each ties."""
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        last = np.ones(len(key), bool)
        last[:-1] = new[1:]
        return base + starts, ~(new & last)

    def _group_sizes(self, rank: np.ndarray, groups: np.ndarray) -> np.ndarray:
        counts = np.bincount(rank, minlength=self.n)
        return counts[groups]

    def lengths(self) -> np.ndarray:
        """Match lengths in text order: counted at the samples, one less from each position to the next."""
        at = self.heads[self.heads > 0]
        x, y = self.order[at], self.order[at - 1]
        most = np.minimum(self.left[x], self.left[y])
        got, live, k = most.copy(), np.flatnonzero(most > 0), 0
        words = np.ndarray((len(self.text) - 7,), "<u8", self.text, 0, (1,))
        while len(live):
            odd = words[x[live] + k] ^ words[y[live] + k]
            off = odd != 0
            low = odd[off] & (~odd[off] + np.uint64(1))
            got[live[off]] = np.minimum(most[live[off]], k + np.log2(low.astype(np.float64)).astype(np.int64) // 8)
            k += 8
            live = live[~off]
            live = live[most[live] > k]
        sampled = np.full(self.n, -1, np.int64)
        sampled[x] = got
        if self.n:
            sampled[self.order[0]] = 0
        last = np.maximum.accumulate(np.where(sampled >= 0, np.arange(self.n), 0))
        return np.maximum(sampled[last] - (np.arange(self.n) - last), 0)

    def repeated(self, length: int) -> np.ndarray:
        """Text positions whose ``length`` bytes also start at an earlier position, in text order."""
        match = self.lengths()[self.order]
        new = match < length
        starts = np.flatnonzero(new)
        first = np.minimum.reduceat(self.order, starts) if len(starts) else np.zeros(0, np.int64)
        earliest = first[np.cumsum(new) - 1] if len(starts) else first
        return np.sort(self.order[self.order != earliest])


def _shard(table: pa.Table) -> pa.Table:
    """Marks the repeats among one shard's runs: ranges ``(doc, h, start, stop)``."""
    doc, h, start = (table.column(c).to_numpy() for c in ("doc", "h", "start"))
    order = np.lexsort((start, h, doc))
    strings = table.column("bytes").take(pa.array(order)).to_pylist()
    index = RunIndex(strings)
    marked = index.repeated(LENGTH)
    row = order[index.string[marked]]
    offset = np.array([len(x) for x in strings], np.int64)[index.string[marked]] - index.left[marked]
    d, hh, b = doc[row], h[row], start[row] + offset
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (hh[1:] != hh[:-1]) | (b[1:] > b[:-1] + LENGTH) | (b[1:] < b[:-1])
    heads = np.flatnonzero(new)
    stops = b[np.append(heads[1:], len(b)) - 1] + LENGTH if len(b) else b
    return pa.table([pa.array(d[heads], pa.int64()), pa.array(hh[heads], pa.int32()), pa.array(b[heads], pa.int64()), pa.array(stops, pa.int64())], names=["doc", "h", "start", "stop"])


_RANGES = "doc long, h int, start long, stop long"


def _judged(runs: DataFrame) -> DataFrame:
    """Adds ``again`` (an equal run comes before), ``several`` (its minimizer has different runs) and ``crowd``, their number."""
    w = Window.partitionBy("a").orderBy("gone", "s", "doc", "h", "start")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again = ~F.col("gone") & F.coalesce((F.lag("s").over(w) == F.col("s")) & ~F.lag("gone").over(w), F.lit(False))
    judged = runs.withColumns({"again": again, "several": F.first("s").over(every) != F.last("s").over(every)})
    return judged.withColumn("crowd", F.count_if(~F.col("again")).over(every))


def _as_ranges(judged: DataFrame) -> DataFrame:
    return judged.where("gone or again").select("doc", "h", "start", (F.col("start") + F.col("len")).alias("stop"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """Ranges ``(doc, h, start, stop)`` of ``docs(doc, h, text)`` that repeat an earlier window; they may overlap."""
    runs = docs.select("doc", "h", "text").mapInArrow(_runs, _RUNS)
    judged = cut(_judged(runs).where("gone or again or several").select("a", "doc", "h", "start", "len", "gone", "again", "crowd"))
    ranges = _as_ranges(judged)
    open_runs = judged.where("not gone and not again")
    by_doc = open_runs.groupBy("doc", "h").agg(F.collect_list(F.struct("a", "start", "len", "crowd")).alias("runs"))
    crowded = F.filter("runs", lambda r: r["crowd"] > CROWD)
    rest = F.filter("runs", lambda r: r["crowd"] <= CROWD)
    found = docs.join(by_doc, ["doc", "h"])
    number = open_runs.agg(F.count(F.when(F.col("crowd") <= CROWD, 1)).alias("rest"), F.count(F.when(F.col("crowd") > CROWD, 1)).alias("crowded")).first()
    shape = "a long, doc long, h int, start long, bytes binary"
    if number["rest"]:
        shards = max(1, number["rest"] // SHARD)
        strings = found.select("doc", "h", "text", rest.alias("runs")).where("size(runs) > 0").mapInArrow(_bytes_of_runs, shape)
        ranges = ranges.unionByName(strings.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))).groupBy("shard").applyInArrow(_shard, _RANGES))
    if number["crowded"]:
        strings = found.select("doc", "h", "text", crowded.alias("runs")).where("size(runs) > 0").mapInArrow(_bytes_of_runs, shape)
        ranges = ranges.unionByName(_as_ranges(_judged(strings.mapInArrow(_windows, _RUNS))))
    return ranges


def _cut_out(data: bytes, ranges) -> tuple[bytes, int]:
    """What is left without the union of ``ranges``, and the number of its runs."""
    kept, spans, at = [], 0, 0
    for a, b in sorted((r["start"], r["stop"]) for r in ranges):
        if a > at or not spans:
            spans += 1
            kept.append(data[at:a])
        at = max(at, b)
    kept.append(data[at:])
    return b"".join(kept), spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``kept`` (the bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Null texts count as empty; a null doc_id comes after all others; texts
    under ``LENGTH`` bytes keep all. Rows that share a doc_id are ordered by
    their texts' hash, and rows that also share the text are one document and
    get the same result. Further columns are kept, but for those of the result's
    names.
    """
    doc, text, h, of, name, spots, left = fresh(docs, "doc", "whole", "hash", "of", "name", "ranges", "left")
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), text: whole(), h: F.hash(whole())})
    with scratch() as stay:
        once = cut(keyed.select(F.col(doc).alias("doc"), F.col(h).alias("h"), F.col(text).alias("text")).distinct())
        ranges = cut(repeated_ranges(once))
        stay.append(ranges)
    by_doc = ranges.groupBy(F.col("doc").alias(of), F.col("h").alias(name)).agg(F.collect_list(F.struct("start", "stop")).alias(spots))

    @F.arrow_udf("struct<kept:binary,n_spans:long>")
    def cut_out(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        kept, spans = [], []
        for text, spots in zip(texts.to_pylist(), ranges.to_pylist()):
            left, n = _cut_out(text.encode("utf-8", "surrogatepass"), spots) if text is not None else (None, 0)
            kept.append(left)
            spans.append(n)
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(spans, pa.int64())], names=["kept", "n_spans"])

    # Only texts with something to remove go through Python.
    out = keyed.join(by_doc, (F.col(doc) == F.col(of)) & (F.col(h) == F.col(name)), "left")
    out = out.withColumn(left, cut_out(F.when(F.col(spots).isNotNull(), F.col(text)), F.col(spots)))
    kept = F.coalesce(F.col(left)["kept"], F.col(text).cast("binary"))
    n = F.octet_length(text).cast("long")
    return out.select(*without(docs, "kept", "n_bytes", "n_removed", "n_spans"), kept.alias("kept"), n.alias("n_bytes"), (n - F.octet_length(kept)).alias("n_removed"), F.col(left)["n_spans"].alias("n_spans"))
