"""Periodic runs of words: stretches that repeat with a period at least three times.

Per document, the words that stand q apart are counted for every lag q: those of
frequent words by autocorrelation (FFT, exact after rounding), those of rare
words by differences of their positions. A run of period q needs
``max(LEAST - q, (POWER - 1) * q)`` equal pairs at lag q, so only lags with so
many are scanned for islands of consecutive pairs. What a run explains at the
multiples of its period is taken off their counts: two runs that could both
explain a pair would have one period (Fine and Wilf), so no pair goes twice.

Documents are independent: one pass, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, without

#: Shortest run in words, and how often its period must fit in.
LEAST, POWER = 24, 3

#: Pairs of rare words, and cells of frequent words' indicator rows, held at once.
_PAIRS, _CELLS = 1 << 20, 1 << 20

#: Samples that an island of the least length holds at least.
_SAMPLES = 8


def lag_counts(ids: np.ndarray, top: int) -> np.ndarray:
    """For each lag 0..top, how many words equal the word that many places on; lag 0 is left at 0.

    Words above the square root of the length are frequent: at most as many as
    that, a transform each; the others make at most n * sqrt(n) / 2 pairs, a
    block of them at a time.
    """
    n, counts = len(ids), np.zeros(top + 1, np.int64)
    if top < 1:
        return counts
    often = np.bincount(ids)
    heavy = often > max(8, int(n**0.5))
    words = np.flatnonzero(heavy)
    if len(words):
        size = 1 << int(n + top - 1).bit_length()
        power, step = np.zeros(size // 2 + 1), max(1, _CELLS // size)
        for k in range(0, len(words), step):
            spectrum = np.fft.rfft((ids == words[k : k + step, None]).astype(np.float64), size, axis=1)
            power += (spectrum.real**2 + spectrum.imag**2).sum(0)
        counts[1:] += np.rint(np.fft.irfft(power, size)[1 : top + 1]).astype(np.int64)
    at = np.flatnonzero(~heavy[ids])
    at = at[np.argsort(ids[at], kind="stable")]
    word = ids[at]
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(at) else at
    group = np.repeat(first, np.diff(np.append(first, len(at))))
    before = np.arange(len(at)) - group  # earlier places of the same word
    upto = np.cumsum(before)
    for low in range(0, int(upto[-1]) if len(at) else 0, _PAIRS):
        a, b = np.searchsorted(upto, [low, low + _PAIRS], "right")
        many = before[a:b]
        right = np.repeat(np.arange(a, b), many)
        left = np.arange(len(right)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(group[a:b], many)
        lags = at[right] - at[left]
        counts += np.bincount(lags[lags <= top], minlength=top + 1)
    return counts


def _stretches(equal: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
    return edge.reshape(-1, 2)


def islands(ids: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """(first, end) of all stretches of ``need`` or more consecutive places that equal the word ``lag`` places on.

    Such a stretch covers ``_SAMPLES`` samples at a spacing of need // _SAMPLES,
    so only around that many equal samples in a row are all places compared.
    """
    here, there = ids[:-lag], ids[lag:]
    step = max(1, need // _SAMPLES)
    found = []
    for a, b in _stretches(here[::step] == there[::step]):
        if b - a >= need // step:
            low, high = max(0, a * step - step + 1), min(len(here), b * step)
            for s, e in _stretches(here[low:high] == there[low:high]):
                if e - s >= need:
                    found.append((int(low + s), int(low + e)))
    return found


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    top = len(ids) // POWER
    if len(ids) < LEAST:
        return []
    counts, lags = lag_counts(ids, top), np.arange(top + 1)
    need = np.maximum(LEAST - lags, (POWER - 1) * lags)
    need[0] = len(ids) + 1
    found: dict[tuple[int, int], int] = {}
    for q in np.flatnonzero(counts >= need).tolist():
        if counts[q] < need[q]:
            continue  # runs of its divisors explain too many of them
        for s, e in islands(ids, q, int(need[q])):
            length = e - s + q
            if (s, length) not in found:  # else its smallest period is known
                found[s, length] = q
                multiples = lags[2 * q : length : q]
                counts[multiples] -= length - multiples
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(n: int, of: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in of:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _judge(text: str | None) -> tuple[list[dict], str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space alone
    numbers: dict[bytes, int] = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    found = runs(ids)
    if found:
        words = [words[i] for i in np.flatnonzero(kept(len(ids), found)).tolist()]
    return [{"start": s, "length": length, "period": q} for s, length, q in found], b" ".join(words).decode("utf-8", "surrogatepass")


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``runs`` (array of start, length, period in words) and ``collapsed``.

    ``collapsed`` is the text's words, joined by one space, without those that a
    run repeats. Null and empty texts have no runs and an empty ``collapsed``;
    rows that repeat are judged each; columns of these names are replaced. A
    text needs a few dozen times its words in memory, whatever it repeats.
    """

    @F.arrow_udf("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def judge(texts: pa.Array) -> pa.Array:
        out = [_judge(x) for x in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r for r, _ in out], pa.list_(_RUN)), pa.array([c for _, c in out], pa.string())], names=["runs", "collapsed"])

    (found,) = fresh(docs, "found")
    return docs.withColumn(found, judge(F.col(text))).select(*without(docs, "runs", "collapsed"), F.col(found)["runs"].alias("runs"), F.col(found)["collapsed"].alias("collapsed"))


def strongest(found: Column) -> Column:
    """The run with the greatest length to period, compared without division; ties: smallest start, then period (the runs' order)."""

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.reduce(found, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def seeded(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text's tail repeating itself; which, where and how follows from the id's crc32.

    A null id, a null text and one without words stay as they are.
    """
    names = fresh(docs, "h", "g", "words", "a", "p")
    h, g, words, a, p = (F.col(c) for c in names)
    n = F.size(words).cast("long")
    out = docs.withColumn(names[0], F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn(names[1], F.expr(f"`{names[0]}` div 10"))
    out = out.withColumn(names[2], F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(0))))
    out = out.withColumn(names[3], F.when(n > 0, g % n))
    out = out.withColumn(names[4], F.lit(1) + F.call_function("div", n - a, F.lit(3) + g % 8))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, (F.call_function("div", n - a, p) + 1).cast("int"))), F.lit(1), (n - a).cast("int"))
    edited = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return out.select(*without(docs, "text"), F.when(a.isNotNull(), edited).otherwise(F.col("text")).alias("text"))
