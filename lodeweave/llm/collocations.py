"""Phrases of words that stand together more often than by chance, per language.

Vertical positional lists: a block of documents becomes one sequence of numbered
places, and every word a sorted list of the places where it stands. A phrase is
extended by merge-joining its places, moved on by its length, with the places of
the next words; the length of the list that comes out is its frequency there,
and the lengths of all blocks add up to the exact frequency. Spark shuffles a
block's phrases as one row a bucket of hashes, not one a phrase; a bucket drops
what is infrequent by its hashes and sums the strings of the rest. Level by level
only frequent parts are extended. Which parts are frequent reaches the blocks as a
bitmap of hashes of bounded size: it may let infrequent parts through, whose
phrases the exact sums then drop, and never holds a frequent one back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, scratch

#: Fewest occurrences of a phrase, longest phrase, phrases reported a language, percent of a part's occurrences in a longer phrase that drop it.
LEAST, LONGEST, REPORTED, COVERED = 10, 3, 2000, 50

#: Bits of the bitmap at most (16 MB), and bits for each frequent part below that.
_MOST_BITS, _BITS_EACH = 1 << 27, 16

#: Bytes of text that make a block, that wait for their block at most, and for each bucket of phrases beyond the least number of buckets.
_BLOCK, _WAITING, _BUCKET, _LEAST_BUCKETS = 1 << 22, 1 << 24, 1 << 24, 16

#: Phrases of a block in a bucket, as the shuffle moves them.
_PART = pa.schema([("h", pa.uint64()), ("phrase", pa.string()), ("f", pa.int64())])

#: Lower case, and what ends a piece, as bytes; neither occurs inside a character of several bytes.
_PLAIN = bytes(32 if b == 9 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


@lru_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2^64."""
    up = np.full(n, _FACTOR, np.uint64)
    down = np.full(n, pow(_FACTOR, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


_FACTOR = 0x9E3779B97F4A7C15


def hashes(words: pa.Array, lang: str) -> np.ndarray:
    """64-bit hashes of a language's words: a polynomial of the bytes, scrambled. For bitmaps and buckets only, so equal hashes do no harm."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    up, down = _powers(max(1 << 19, 1 << len(raw).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * up[: len(raw)])))
    at = ends - ends[0]
    h = (sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]] ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _merged(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of two ascending lists of places: the indices of what both have."""
    at = np.searchsorted(right, left)
    same = np.flatnonzero(np.append(right, -1)[at] == left)
    return same, at[same]


class Block:
    """Documents of one language as a sequence of places: the number of the word at each, -1 between pieces."""

    def __init__(self, lang: str, texts: list[bytes]):
        raw = np.frombuffer(b".".join(texts).translate(_PLAIN), np.uint8)
        ends = raw == 46
        solid = ~(ends | (raw == 32))
        edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        offsets = np.concatenate(([0], np.cumsum(edges[1::2] - edges[::2]))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw[solid])])
        coded = words.dictionary_encode()
        piece = np.cumsum(ends, dtype=np.int32)[edges[::2]]  # of each word
        places = np.arange(len(piece)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
        self.lang, self.names, self.ids = lang, coded.dictionary, np.full(places[-1] + 1 if len(places) else 0, -1, np.int32)
        self.ids[places] = coded.indices.to_numpy()

    def counted(self, bitmaps: list[np.ndarray]) -> pa.RecordBatch:
        """Frequencies of the phrases of len(bitmaps) + 1 words whose parts the bitmaps let through; of single words also the sum, without a phrase."""
        if not bitmaps:
            lengths = np.bincount(self.ids[self.ids >= 0], minlength=len(self.names))
            some = np.flatnonzero(lengths)
            names = pa.concat_arrays([self.names.take(pa.array(some)).cast(pa.string()), pa.array([None], pa.string())])
            return self._rows(np.append(hashes(self.names, self.lang)[some], np.uint64(0)), names, np.append(lengths[some], lengths.sum()))
        of = hashes(self.names, self.lang)
        words = np.flatnonzero((self.ids >= 0) & np.append(_lets(bitmaps[0], of), False)[self.ids])  # places of frequent words
        places, h = words, of[self.ids[words]]
        for length in range(1, len(bitmaps) + 1):
            if length > 1:
                keep = _lets(bitmaps[length - 1], h)
                places, h = places[keep], h[keep]
            left, right = _merged(places + length, words)
            longer, h = places[left], h[left] ^ _turned(of[self.ids[words[right]]], length)
            if length > 1:  # the words but the first are a frequent phrase too
                tail, _ = _merged(longer + 1, places)
                longer, h = longer[tail], h[tail]
            places = longer
        heads, phrases, lengths = self._lists(places, len(bitmaps) + 1)
        return self._rows(h[heads], phrases, lengths)

    def dealt(self, bitmaps: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
        """The phrases that :meth:`counted` returns, packed: one row a bucket of hashes."""
        rows = self.counted(bitmaps)
        bucket = (rows.column("h").to_numpy() % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
        order = np.argsort(bucket, kind="stable")
        rows, ends = rows.take(pa.array(order)), np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
        used = np.flatnonzero(np.diff(ends))
        for some in (used[k : k + 64] for k in range(0, len(used), 64)):
            parts = [rows.slice(ends[k], ends[k + 1] - ends[k]).serialize().to_pybytes() for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([self.lang] * len(some), pa.string()), pa.array(parts, pa.binary())], names=["bucket", "lang", "part"])

    def _lists(self, places: np.ndarray, length: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The phrases at ``places``, for each the index of one of its places, and the lengths of their lists."""
        n = len(self.names)
        keys = self.ids[places].astype(np.int64)
        for k in range(1, length):
            if k > 1 and n**(k + 1) >> 62:
                keys = np.unique(keys, return_inverse=True)[1].astype(np.int64)
            keys = keys * n + self.ids[places + k]
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else order
        heads = places[order[first]]
        phrases = pc.binary_join_element_wise(*[self.names.take(pa.array(self.ids[heads + k])) for k in range(length)], b" ")
        return order[first], phrases.cast(pa.string()), np.diff(np.append(first, len(keys)))

    def _rows(self, h: np.ndarray, phrases: pa.Array, lengths: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h, pa.uint64()), phrases, pa.array(lengths, pa.int64())], schema=_PART)


def summed(rows: pa.Table, least: int) -> pa.Table:
    """(lang, phrase, f) of a bucket's phrases with f >= ``least`` and of null phrases; hashes only drop phrases early whose cell has less."""
    parts = [pa.ipc.read_record_batch(part.as_buffer(), _PART) for part in rows.column("part")]
    langs = rows.column("lang").combine_chunks().take(pa.array(np.repeat(np.arange(len(parts)), [p.num_rows for p in parts])))
    table = pa.Table.from_batches(parts, _PART)
    cell = table.column("h").to_numpy() >> np.uint64(64 - max(1, (4 * table.num_rows).bit_length()))
    cell = cell.astype(np.int64)
    often = np.bincount(cell, table.column("f").to_numpy())[cell] >= least
    often |= table.column("phrase").is_null().to_numpy()
    some = table.select(["phrase", "f"]).append_column("lang", langs).filter(pa.array(often))
    out = some.group_by(["lang", "phrase"], use_threads=False).aggregate([("f", "sum")])
    out = out.filter(pc.or_(pc.greater_equal(out.column("f_sum"), least), out.column("phrase").is_null()))
    return pa.table([out.column("lang"), out.column("phrase"), out.column("f_sum")], names=["lang", "phrase", "f"])


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return h << np.uint64(by) | h >> np.uint64(64 - by)


def _lets(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = (hashes & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[bits >> 3] >> (bits & 7) & 1).astype(bool)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    held = 0
    for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):  # few texts at once as objects
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                data = text.encode("utf-8", "surrogatepass")
                waiting.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
                held += len(data)
                if sizes[lang] >= _BLOCK or held >= _WAITING:
                    most = max(sizes, key=sizes.get)
                    held -= sizes.pop(most)
                    yield Block(most, waiting.pop(most))
    for lang, texts in waiting.items():
        yield Block(lang, texts)


def _phrase_hashes(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """Hashes of phrases: those of their words, each turned by its place."""
    out = np.zeros(batch.num_rows, np.uint64)
    langs = batch.column("lang").to_numpy(zero_copy_only=False)
    for lang in set(langs):
        at = np.flatnonzero(langs == lang)
        words = pc.split_pattern(batch.column("phrase").take(pa.array(at)), " ").flatten()
        h = hashes(words.cast(pa.binary()), lang).reshape(-1, length)
        for k in range(length):
            out[at] ^= _turned(h[:, k], k) if k else h[:, k]
    return out


def bitmap(frequent: DataFrame, length: int) -> np.ndarray:
    """The hashes of phrases of ``length`` words as a bitmap of at most 16 MB."""
    bits = min(_MOST_BITS, 1 << max(15, (_BITS_EACH * frequent.count()).bit_length()))

    def bit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _phrase_hashes(batch, length) & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64) + 1)], names=["bit"])

    numbered = frequent.select("lang", "phrase").mapInArrow(bit, "bit bigint").select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("position"))
    out = np.zeros(bits // 8, np.uint8)
    for row in numbered.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("position").alias("part")).collect():
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(row.part, np.uint8)
    return out


def parts(docs: DataFrame, bitmaps: list[np.ndarray], buckets: int) -> DataFrame:
    """(bucket, lang, part): the phrases of len(bitmaps) + 1 words of each block, one row a bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield from block.dealt(shared.value, buckets)

    return docs.mapInArrow(deal, "bucket int, lang string, part binary")


def counted(docs: DataFrame, bitmaps: list[np.ndarray], least: int, buckets: int) -> DataFrame:
    """(lang, phrase, f) of all phrases of len(bitmaps) + 1 words with f >= ``least``; with no bitmaps also each language's sum, phrase null."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if some := list(batches):
            yield from summed(pa.Table.from_batches(some), least).to_batches()

    # a task a bucket: hashed to fewer partitions, some would get several times the others' share
    return parts(docs, bitmaps, buckets).repartitionById(buckets, "bucket").mapInArrow(add, "lang string, phrase string, f bigint")


def _score(a: Column, first: Column, rest: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), in whole numbers of up to 38 digits: exact up to 10^15 occurrences."""
    d = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * d(a) * d(a), d(first) * d(rest))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, reported: int = REPORTED, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's strongest phrases.

    A null language is ``und``, null and empty texts have no words; rows that
    repeat count each. Phrases don't cross ``. , ; : ! ?`` or line ends. ``least``
    is at least 1, so parts of a frequent phrase are frequent. Without phrases
    the result is empty.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    buckets = _LEAST_BUCKETS + (docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // _BUCKET
    with scratch() as kept:
        levels, bitmaps = [], []
        for length in range(1, longest + 1):
            levels.append(cut(counted(docs, bitmaps, least, buckets)))
            if length < longest:
                bitmaps.append(bitmap(levels[-1].where("phrase is not null"), length))
        known = levels[0].where("phrase is not null").withColumn("words", F.lit(1))
        for length in range(2, longest + 1):
            known = known.unionByName(levels[length - 1].withColumn("words", F.lit(length)))
        candidates = known.where("words > 1")
        out = cut(_ranked(candidates, known, levels[0].where("phrase is null").select("lang", F.col("f").alias("n")), longest, reported, covered))
        kept.append(out)
    return out


def _ranked(candidates: DataFrame, known: DataFrame, sizes: DataFrame, longest: int, reported: int, covered: int) -> DataFrame:
    part = lambda first, length: F.array_join(F.slice(F.split("phrase", " "), first, length), " ")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "words", "f", "k", F.inline(F.array(F.struct(F.lit(True).alias("first"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))))
    of = known.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    side = lambda k, first: F.max(F.when((F.col("k") == k) & (F.col("first") == first), F.col("part_f"))).alias(f"{'l' if first else 'r'}{k}")
    places = range(1, max(longest, 2))
    lengths = sides.join(of, ["lang", "part"]).groupBy("lang", "phrase").agg(F.max("f").alias("a"), *[side(k, first) for k in places for first in (True, False)])
    each = [F.when(F.col(f"l{k}").isNotNull(), F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in places]
    weakest = lengths.select("lang", "phrase", "a", F.array_min(F.array(*each)).alias("at"))  # nulls are no cuts
    inner = candidates.where("words > 2").select("lang", "f", "phrase", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("length"), "words")
    inner = inner.select("lang", "f", "phrase", "length", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)).alias("at"))
    longer = inner.groupBy("lang", part(F.col("at"), F.col("length")).alias("phrase")).agg(F.max("f").alias("longer"))
    stay = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).select("lang", "phrase", "a", "at.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # ranked in parts first, so that a language's last sort has reported * 64 rows at most
    salted = stay.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    best = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= reported)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= reported)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), worded AS (
    SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM pieces
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM worded, (VALUES (1), (2), (3)) v(k)
), f AS (
    SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), c AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {LEAST}
), cuts AS (
    SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), scored AS (
    SELECT x.lang, x.phrase, x.k, x.a, j, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
    FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = head JOIN f r ON r.lang = x.lang AND r.phrase = tail
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), longer AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE k = 3) GROUP BY lang, phrase
), n AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM weakest LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang)
WHERE longer IS NULL OR 100 * longer < {COVERED} * a
QUALIFY rank <= {REPORTED}
"""
