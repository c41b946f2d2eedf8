"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause through a chain of weighted transducers:

- the lexicon maps a word to a symbol: an insult or threat with a weight (by a
  trie of word stems), a target (second person), a negation, a reported-speech
  marker or other;
- ``negations`` marks insults and threats within reach of a negation;
- ``reports`` marks those after a reported-speech marker;
- ``targets`` accepts a clause with one marked insult or threat, aimed at a
  target that stands anywhere in the clause, or bare.

The last three are states and arcs; they are composed once into one machine
over the lexicon's symbols. A clause's weight is that of its best path: the
word's weight times the weight of the accepted pattern. A document's score is
the noisy-or of its clauses, so no word counts outside the pattern its clause
matched. Without labels a negated, reported or bare insult alone stays below
the threshold; labelled rows say how far each pattern really holds.

Stem weights are smoothed precisions counted over labelled rows, pattern
weights the toxic share of the texts a pattern judged. Both are learnt from all
labelled training rows or, where there are more, a hash sample of about
``FIT_ROWS`` of them; that bound is a parameter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from typing import NamedTuple
from zlib import crc32

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, scratch

FIT_ROWS = 24_000
#: Least evidence (nats of a binomial likelihood ratio) and precision of a learnt stem.
EVIDENCE, PRECISION = 14.0, 0.6
THRESHOLD = 0.3
#: Score of a text without a matched clause.
FLOOR = 0.01

# Starting words, whole; counts over labelled rows override their weight.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown imbecile bastard dumpf trottel idiotisch dummkopf abschaum wertlos imbécile crétin ordure minable imbécil estúpido basura escoria inútil".split()
THREATS = "kill hurt destroy crush töten vernichten umbringen tuer détruire écraser matar destruir".split()
TARGETS = frozenset("you your you're youre yours u du dich dir dein deine deiner sie ihr tu toi ton ta tes vous votre vos tú ti usted ustedes".split())
NEGATIONS = frozenset("not no never nobody isn't aren't don't doesn't nicht kein keine niemals pas jamais nunca jamás".split())
REPORTS = frozenset("said says saying called wrote writes quoted reported sagte schrieb nannte dit disait écrit dijo decía escribió llamó".split())
PRIOR = 0.5
#: Words that a negation reaches.
REACH = 3
#: Weights of the patterns before anything is learnt: bare insults and threats, and factors of negated and reported ones.
BARE, BARE_THREAT, NEGATED, REPORTED = 0.3, 0.1, 0.25, 0.3
#: Texts' worth of trust in these weights.
TRUST = 4.0

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")
_STEM_LENGTHS = (4, 5, 6)


# Transducers: states and arcs as data, and their composition.

SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")
#: What a hit is after the marks of negation and report; and the patterns that a clause can match.
HITS = tuple(kind + marks for kind in ("insult", "threat") for marks in ("", "+negated", "+reported", "+negated+reported"))


def _pattern(hit: str, aimed: bool) -> str:
    return ("aimed " if aimed else "bare ") + hit


def _prior(hit: str, aimed: bool) -> float:
    weight = 1.0 if aimed else BARE_THREAT if hit.startswith("threat") else BARE
    return weight * (NEGATED if "+negated" in hit else 1.0) * (REPORTED if "+reported" in hit else 1.0)


PATTERNS = {_pattern(hit, aimed): _prior(hit, aimed) for hit in HITS for aimed in (True, False)}


class Transducer:
    """A weighted transducer: ``arcs[state][symbol]`` lists (output, weight, next state); finals have a weight and a name."""

    def __init__(self, start, arcs: dict, finals: dict):
        self.start, self.arcs, self.finals = start, arcs, finals

    def best(self, read: Iterable[tuple[str, float]]) -> tuple[float, str]:
        """Weight and final's name of the best path over weighted symbols; weights multiply along a path."""
        open_ = {self.start: 1.0}
        for symbol, factor in read:
            after: dict = {}
            for state, weight in open_.items():
                for output, w, to in self.arcs[state][symbol]:
                    # A word's weight belongs to the path that takes the word as its hit.
                    value = weight * w * (factor if output == TAKEN else 1.0)
                    if value > after.get(to, 0.0):
                        after[to] = value
            open_ = after
        return max(((w * self.finals[s][0], self.finals[s][1]) for s, w in open_.items() if s in self.finals), default=(0.0, ""))


TAKEN, PASSED = "taken", "passed"


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds the outputs of ``first`` to ``second``: pairs of states that can be reached."""
    start = (first.start, second.start)
    arcs, todo = {}, [start]
    while todo:
        a, b = pair = todo.pop()
        if pair in arcs:
            continue
        arcs[pair] = {}
        for symbol, ways in first.arcs[a].items():
            both = [(out, w * v, (a2, b2)) for mid, w, a2 in ways for out, v, b2 in second.arcs[b][mid]]
            arcs[pair][symbol] = both
            todo += [to for _, _, to in both]
    finals = {(a, b): (first.finals[a][0] * second.finals[b][0], second.finals[b][1]) for a, b in arcs if a in first.finals and b in second.finals}
    return Transducer(start, arcs, finals)


def negations() -> Transducer:
    """Marks hits among the ``REACH`` words after a negation; its states count those that are left."""
    arcs = {}
    for left in range(REACH + 1):
        after = max(0, left - 1)
        arcs[left] = {s: [(s, 1.0, after)] for s in SYMBOLS} | {"negation": [("other", 1.0, REACH)]}
        if left:
            arcs[left] |= {kind: [(kind + "+negated", 1.0, after)] for kind in ("insult", "threat")}
    return Transducer(0, arcs, {k: (1.0, "") for k in arcs})


def reports() -> Transducer:
    """Marks hits after a reported-speech marker."""
    read = ("insult", "insult+negated", "threat", "threat+negated", "target", "other")
    plain = {s: [(s, 1.0, "plain")] for s in read} | {"report": [("other", 1.0, "told")]}
    told = {s: [(s + "+reported" if s.startswith(("insult", "threat")) else s, 1.0, "told")] for s in read} | {"report": [("other", 1.0, "told")]}
    return Transducer("plain", {"plain": plain, "told": told}, {"plain": (1.0, ""), "told": (1.0, "")})


def targets(weights: dict[str, float]) -> Transducer:
    """Accepts a clause by one hit, which a path takes or passes by, aimed if a target stands before or after it."""
    arcs, finals = {}, {}
    for aimed in (False, True):
        free = ("free", aimed)
        arcs[free] = {"other": [(PASSED, 1.0, free)], "target": [(PASSED, 1.0, ("free", True))]}
        arcs[free] |= {hit: [(TAKEN, 1.0, (hit, aimed)), (PASSED, 1.0, free)] for hit in HITS}
        for hit in HITS:
            arcs[hit, aimed] = {s: [(PASSED, 1.0, (hit, aimed))] for s in ("other", *HITS)} | {"target": [(PASSED, 1.0, (hit, True))]}
            finals[hit, aimed] = (weights[_pattern(hit, aimed)], _pattern(hit, aimed))
    return Transducer(("free", False), arcs, finals)


class Weights(NamedTuple):
    """What is learnt."""

    stems: dict[str, float]
    patterns: dict[str, float]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _stems(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in _STEM_LENGTHS if len(word) >= n)]


def _count_stems(batches):
    """Clean and toxic texts of each stem, and a bitmap of the words before it in toxic ones.

    Copies of a text repeat these words too, so the bitmap tells whether a stem
    is common in toxic texts or in one much copied toxic text.
    """
    counts: dict[str, list[int]] = {}

    def flush():
        kept = list(counts.items())
        counts.clear()
        columns = [[k for k, _ in kept], *([v[i] for _, v in kept] for i in range(2)), [v[2] - (1 << 64) if v[2] >> 63 else v[2] for _, v in kept]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["stem", "clean", "toxic", "before"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = _WORD.findall((text or "").lower())
            for stem in {s for w in set(words) for s in _stems(w)}:
                counts.setdefault(stem, [0, 0, 0])[bool(toxic)] += 1
            if toxic:
                for before, word in zip(["", *words], words):
                    bit = 1 << (crc32(before.encode()) & 63)
                    for stem in _stems(word):
                        counts[stem][2] |= bit
            if len(counts) > 400_000:
                yield flush()
    yield flush()


def _evidence(t: float, c: float, share: float) -> float:
    """Log likelihood ratio of t toxic and c clean texts against the share of all."""
    p = t / (t + c) if t + c > 0 else 0.0
    return t * math.log(p / share) + (c * math.log((1 - p) / (1 - share)) if c > 0 else 0.0) if p > share else 0.0


def _pick(rows: list, share: float) -> dict[str, float]:
    """Stems that tell, longest first; what a longer one explains doesn't count for a shorter one."""
    picked: dict[str, tuple[float, float]] = {}
    for length in (0, *sorted(_STEM_LENGTHS, reverse=True)):
        for stem, clean, toxic, contexts in rows:
            if (0 if stem[-1] == "$" else len(stem)) != length:
                continue
            under = [v for s, v in picked.items() if length and s.startswith(stem)]
            t, c = toxic - sum(v[0] for v in under), clean - sum(v[1] for v in under)
            seen = min(1.0, contexts / max(1, toxic))
            family = len(under) > 1 and t > 0 and c <= 0.1 * t  # the rest of a stem of which two words tell already
            if family or t > 2 and t / (t + max(c, 0)) >= max(PRECISION, share) and seen * _evidence(t, max(c, 0), share) >= EVIDENCE:
                for s in [s for s in picked if length and s.startswith(stem)]:
                    del picked[s]
                picked[stem] = (toxic, clean)
    return {s: (t + share) / (t + c + 1) for s, (t, c) in picked.items()}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Weights:
    """Weights of stems (``word$`` for a whole word, else a prefix of words) and of patterns.

    Rows with a null doc_id, text or label, and held-out rows, teach nothing;
    with no labelled rows of both kinds the starting words keep their prior weight.
    """
    with scratch():
        return _learnt(docs, labels, fit_rows)


def _learnt(docs: DataFrame, labels: DataFrame, fit_rows: int) -> Weights:
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    n = train.count()
    if n > fit_rows:
        train = train.where(F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))
    train = cut(train)
    # The sample is small by its bound, unless one id is labelled very often.
    few = F.broadcast(train) if train.count() <= 2 * fit_rows else train
    rows = cut(docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("_id")).select("text", F.col("_toxic").cast("int")))
    counted = rows.mapInArrow(_count_stems, "stem string, clean long, toxic long, before long").groupBy("stem").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"), F.bit_count(F.bit_or("before")).alias("bits"))
    share = train.agg(F.avg(F.col("_toxic").cast("int"))).first()[0]
    prior = [w + "$" for w in (*INSULTS, *THREATS)]
    if not share or share >= 1:
        return Weights(dict.fromkeys(prior, PRIOR), dict(PATTERNS))
    # Distinct words before a stem, from how full the bitmap is.
    contexts = -64.0 * F.log(F.greatest(F.lit(0.25), 64.0 - F.col("bits")) / 64.0)
    told = F.col("t") * F.log(F.col("t") / (F.col("t") + F.col("c")) / share)
    asked = F.col("stem").isin(prior)
    wanted = counted.where(asked | ((F.col("t") > 3) & (F.col("t") >= PRECISION / 2 * (F.col("t") + F.col("c"))) & (told >= EVIDENCE))).select("stem", "c", "t", contexts.alias("contexts"))
    # Few of the sample's stems tell so much; their number is bounded by the sample's words.
    found = sorted((tuple(r) for r in wanted.collect()), key=lambda r: (-r[2], r[0]))
    stems = dict.fromkeys(prior, PRIOR) | _pick(found, share)
    known = {stem: (c, t) for stem, c, t, _ in found}
    stems |= {s: (known[s][1] + 4 * PRIOR) / (sum(known[s]) + 4) for s in prior if s in known}
    return Weights(stems, _pattern_weights(rows, stems))


def _pattern_weights(rows: DataFrame, stems: dict[str, float]) -> dict[str, float]:
    """For each pattern the toxic texts it judged, as a share of those that its words' weights promise."""

    def judged(batches):
        grammar = _grammar(Weights(stems, dict(PATTERNS)))
        for batch in batches:
            names, promised, toxic = [], [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if best := max(grammar.clauses(text or ""), key=lambda c: c[2], default=None):
                    names.append(best[3])
                    promised.append(best[2] / PATTERNS[best[3]])
                    toxic.append(float(bool(label)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(promised, pa.float64()), pa.array(toxic, pa.float64())], names=["pattern", "promised", "toxic"])

    sums = rows.mapInArrow(judged, "pattern string, promised double, toxic double").groupBy("pattern").agg(F.sum("promised").alias("p"), F.sum("toxic").alias("t"))
    told = {r["pattern"]: (r["p"], r["t"]) for r in sums.collect()}  # a row a pattern at most
    return {p: min(1.0, (told.get(p, (0, 0))[1] + TRUST * w) / (told.get(p, (0, 0))[0] + TRUST)) for p, w in PATTERNS.items()}


class Grammar:
    """The lexicon and the composed transducers for one set of weights."""

    def __init__(self, weights: Weights):
        self.stems = weights.stems
        self.threats = frozenset(THREATS)
        self.machine = compose(compose(negations(), reports()), targets(weights.patterns))
        self.trie = ahocorasick.Automaton()
        for stem in self.stems:
            self.trie.add_word(stem.rstrip("$"), stem)
        self.trie.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        """The lexicon."""
        best = self.stems.get(word + "$", 0.0)
        for n in _STEM_LENGTHS:
            best = max(best, self.stems.get(word[:n], 0.0)) if len(word) >= n else best
        if best:
            return ("threat" if word in self.threats else "insult"), best
        for kind, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)):
            if word in words:
                return kind, 1.0
        return "other", 1.0

    def clause(self, text: str) -> tuple[float, str]:
        """Weight and pattern of a clause's best path; no match is ``(0, "")``."""
        return self.machine.best(map(self.symbol, _WORD.findall(text)))

    def clauses(self, text: str) -> list[tuple[int, int, float, str]]:
        """Spans, weights and patterns of the clauses that match, in code points of the lower-cased text."""
        low, out = text.lower(), []
        hits = []
        for end, stem in self.trie.iter(low):
            start = end - len(stem.rstrip("$")) + 1
            if (not start or not low[start - 1].isalpha()) and (stem[-1] != "$" or end + 1 == len(low) or not low[end + 1].isalpha()):
                hits.append(start)
        if not hits:
            return out
        hits.sort()
        at, k = 0, 0
        for start, stop in [*(m.span() for m in _CLAUSE.finditer(low)), (len(low), len(low))]:
            if k < len(hits) and hits[k] < start:
                weight, pattern = self.clause(low[at:start])
                if weight:
                    out.append((at, start, weight, pattern))
                while k < len(hits) and hits[k] < start:
                    k += 1
            at = stop
        return out


def _score(clauses: list) -> float:
    return min(1.0, max(FLOOR, 1 - math.prod(1 - c[2] for c in clauses)))


_TYPE = "struct<score:double,clauses:array<struct<start:int,stop:int,weight:double,pattern:string>>>"
_CLAUSES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("weight", pa.float64()), ("pattern", pa.string())]))


def toxicity(text: Column, weights: Weights) -> Column:
    """``struct(score, clauses)`` of a text column; null and empty texts score ``FLOOR``."""

    @F.arrow_udf(_TYPE)
    def apply(texts: pa.Array) -> pa.Array:
        grammar = _grammar(weights)
        rows = [grammar.clauses(x) if x else [] for x in texts.to_pylist()]
        spans = [[{"start": a, "stop": b, "weight": w, "pattern": p} for a, b, w, p in r] for r in rows]
        return pa.StructArray.from_arrays([pa.array([_score(r) for r in rows], pa.float64()), pa.array(spans, _CLAUSES)], names=["score", "clauses"])

    return apply(text)


_built: list = []


def _grammar(weights: Weights) -> Grammar:
    """One grammar for each worker process and set of weights."""
    if not _built or _built[0] != weights:
        _built[:] = [weights, Grammar(weights)]
    return _built[1]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` plus ``toxicity`` (score and matched clauses) by weights learnt from ``labels``.

    Every row keeps its columns (one named ``toxicity`` is replaced); null and
    empty texts score ``FLOOR``; repeated rows score alike; columns of
    ``labels`` besides doc_id and toxic are ignored, rows of it that repeat
    count again.
    """
    return docs.withColumn("toxicity", toxicity(F.col("text"), fit(docs, labels)))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, with all columns.

    Null and empty texts and rows without an id stay; rows that repeat stay or
    go together; an empty table stays empty; columns may have any names.
    """
    (judged,) = fresh(docs, "judged")
    scored = docs.withColumn(judged, toxicity(F.col("text"), fit(docs, labels)))
    return scored.where(F.col(judged)["score"] < threshold).drop(judged)
