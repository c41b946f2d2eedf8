"""Licence scans by a positional rare-token index.

A template is a licence with mandatory key phrases and further ones. One pass
keeps, for each file, the places of the words that these phrases use. Document
frequencies of these words come from that table; the rare-token index has each
phrase under its word of highest IDF. A file looks up its words there, so
phrases without their rarest word cost it nothing. For the phrases found, every
place of one of their words proposes a start, the place less the word's place in
the phrase. Sorted, the proposals of one start stand together, and the phrase
stands where they are as many as it has words: each word then is at its relative
position. A template's label is given where all its mandatory phrases stand; the
score is the largest share of a template's phrases that do. Time grows with the
words of a file, also where one phrase fills it. All of it is array functions
within a row; only the frequencies are aggregated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, whole, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that the contract fixes: (label, phrase).
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Licence texts and notices: (label, mandatory phrases, further phrases).
MORE = (
    ("all-rights-reserved", ("all rights reserved",), ()),
    ("mit", ("permission is hereby granted free of charge to any person obtaining a copy", "the software is provided as is without warranty of any kind"), ("the above copyright notice and this permission notice shall be included in all copies",)),
    ("mit", ("released under mit",), ()),
    ("isc", ("permission to use copy modify and or distribute this software for any purpose", "the author disclaims all warranties"), ("the above copyright notice and this permission notice appear in all copies",)),
    ("apache-2", ("licensed under the apache license", "distributed on an as is basis"), ("you may not use this file except in compliance with the license", "without warranties or conditions of any kind")),
    ("apache-2", ("apache license version 2 0",), ("terms and conditions for use reproduction and distribution",)),
    ("bsd-2", ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"), ("redistributions in binary form must reproduce the above copyright notice",)),
    ("bsd-3", ("redistribution and use in source and binary forms", "may be used to endorse or promote products derived from this software"), ("redistributions in binary form must reproduce the above copyright notice",)),
    ("bsd", ("bsd 3 clause license",), ()),
    ("gpl", ("gnu general public license", "free software foundation"), ("you can redistribute it and or modify it under the terms of", "without even the implied warranty of merchantability")),
    ("gpl", ("gnu general public license version",), ()),
    ("lgpl", ("gnu lesser general public license",), ("free software foundation",)),
    ("agpl", ("gnu affero general public license",), ("free software foundation",)),
    ("mpl-2", ("mozilla public license", "v 2 0"), ("if a copy of the mpl was not distributed with this file",)),
    ("mpl-2", ("mozilla public license version 2",), ()),
    ("cc-by-sa", ("cc by sa",), ()),
    ("cc-by-nd", ("cc by nd",), ()),
    ("cc0", ("cc0 1 0 universal",), ()),
    ("unlicense", ("free and unencumbered software released into the public domain",), ("anyone is free to copy modify publish use compile sell or distribute this software",)),
)


def phrases_of(base, more) -> list[str]:
    """All phrases once each, the base ones first."""
    return list(dict.fromkeys([p for _, p in base] + [p for _, must, may in more for p in (*must, *may)]))


#: Bits of a proposal for the start; a start before the text's first word proposes nothing.
_BITS = 40


def _vocabulary(phrases) -> list[str]:
    return sorted({w for phrase in phrases for w in phrase.split()})


def postings(docs: DataFrame, phrases) -> DataFrame:
    """``docs`` without text, plus ``n_words`` and ``hits``: (number from 0, place from 0) of words of the phrases."""
    vocabulary = _vocabulary(phrases)
    words = F.regexp_extract_all(ascii_lower(whole()), F.lit(WORD), F.lit(0))
    known = F.array(*map(F.lit, vocabulary))
    hit = lambda w, i: F.when(w.isin(vocabulary), F.struct((F.array_position(known, w) - 1).cast("int").alias("n"), i.alias("i")))
    rest = without(docs, "text", "n_words", "hits", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    both = F.get(F.transform(F.array(words), lambda x: F.struct(F.size(x).cast("long").alias("n"), F.filter(F.transform(x, hit), lambda h: h.isNotNull()).alias("hits"))), F.lit(0))
    found = docs.select(F.struct(*rest).alias("row"), both.alias("found"))
    return found.select("row", F.col("found.n").alias("n_words"), F.col("found.hits").alias("hits"))


def frequencies(index: DataFrame) -> dict[int, int]:
    """Documents that have each template word, by its number; a row for each word of the vocabulary at most."""
    words = index.select(F.explode(F.array_distinct("hits.n")).alias("n"))
    return {r["n"]: r["count"] for r in words.groupBy("n").count().collect()}


def _listed(lists: list[list], kind: str) -> Column:
    return F.array(*[F.array(*x).cast(kind) for x in lists])


def _matches(phrases, counts: dict[int, int], documents: int) -> Column:
    """Sorted ``phrase << _BITS | start`` of all phrases that stand in a row of ``hits``."""
    vocabulary = {w: n for n, w in enumerate(_vocabulary(phrases))}
    phrases = [[vocabulary[w] for w in phrase.split()] for phrase in phrases]
    idf = lambda n: math.log((documents + 1) / (counts.get(n, 0) + 1))
    rarest = [max(p, key=lambda n: (idf(n), n)) for p in phrases]
    index = _listed([[F.lit(t) for t, r in enumerate(rarest) if r == n] for n in range(len(vocabulary))], "array<int>")
    places = _listed([[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, p in enumerate(phrases) for k, w in enumerate(p) if w == n] for n in range(len(vocabulary))], "array<struct<t:int,k:int>>")
    sizes = F.array(*[F.lit(len(p)) for p in phrases])

    looked_up = F.flatten(F.transform(F.array_distinct("hits.n"), lambda n: F.get(index, n)))

    def proposals(found):
        starts = lambda x: F.transform(F.filter(F.get(places, x["n"]), lambda p: F.array_contains(found, p["t"]) & (x["i"] >= p["k"])), lambda p: F.shiftleft(p["t"].cast("long"), _BITS) + x["i"] - p["k"])
        return F.sort_array(F.flatten(F.transform("hits", starts)))

    def whole_phrases(sorted_):
        template = lambda x: F.shiftright(x, _BITS).cast("int")
        first = lambda x, j: (j == 0) | (F.get(sorted_, j - 1) != x)
        last = lambda x, j: F.get(sorted_, j + F.get(sizes, template(x)) - 1) == x
        return F.filter(sorted_, lambda x, j: F.coalesce(first(x, j) & last(x, j), F.lit(False)))

    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  names a value that inner functions share
    none = F.array().cast("array<bigint>")
    return let(looked_up, lambda found: F.when(F.size(found) > 0, let(proposals(found), whole_phrases)).otherwise(none))


def scan(docs: DataFrame, base=BASE, more=MORE) -> DataFrame:
    """``docs`` without text, plus n_words, n_base, first_word, last_word, base_labels, labels and score.

    Columns of the result's names are replaced, all others kept. A null or
    empty text has no words and no labels; every row stays, repeated or not; an
    empty table gives an empty one. A start counts once for each phrase that
    stands there; ``labels`` are the base ones and those of all templates whose
    mandatory phrases stand, wherever. The score is 1 where a base phrase or all
    of a template's phrases stand, else the largest share of them that do.
    """
    phrases = phrases_of(base, more)
    number = {p: k for k, p in enumerate(phrases)}
    index = cut(postings(docs, phrases))
    found = index.select("row", "n_words", _matches(phrases, frequencies(index), index.count()).alias("starts"))
    at = lambda x: x.bitwiseAND(F.lit((1 << _BITS) - 1))
    found = found.withColumn("own", F.transform(F.filter("starts", lambda x: x < (len(base) << _BITS)), at))
    found = found.withColumn("stand", F.array_distinct(F.transform("starts", lambda x: F.shiftright(x, _BITS).cast("int"))))
    these = lambda some: F.array(*[F.lit(number[p]) for p in some])
    held = lambda some: F.size(F.array_intersect("stand", these(some)))
    named = [F.when(F.array_contains("stand", number[p]), F.lit(name)) for name, p in base]
    given = [F.when(held(must) == len(set(must)), F.lit(name)) for name, must, _ in more]
    listed = lambda some: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*some)))), ",")
    shares = [F.when(F.size("own") > 0, 1.0).otherwise(0.0)] + [held((*must, *may)) / float(len({*must, *may})) for _, must, may in more]
    score = F.when(F.size("stand") > 0, F.greatest(*shares)).otherwise(0.0)
    return found.select(
        "row.*", "n_words", F.size("own").cast("long").alias("n_base"), F.array_min("own").alias("first_word"), F.array_max("own").alias("last_word"),
        listed(named).alias("base_labels"), listed(named + given).alias("labels"), score.alias("score"),
    )


def _sql_starts(phrase: str) -> str:
    words = phrase.split()
    return f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(words))})"


def oracle() -> str:
    """DuckDB SQL for the query's rows."""
    phrases = phrases_of(BASE, MORE)
    number = {p: k for k, p in enumerate(phrases)}
    arrays = ", ".join(f"{_sql_starts(p)} AS s{k}" for k, p in enumerate(phrases))
    stands = lambda p: f"len(s{number[p]}) > 0"
    named = [f"CASE WHEN {stands(p)} THEN '{name}' END" for name, p in BASE]
    given = [f"CASE WHEN {' AND '.join(map(stands, must))} THEN '{name}' END" for name, must, _ in MORE]
    listed = lambda some: f"array_to_string(list_sort(list_distinct([x for x in [{', '.join(some)}] if x IS NOT NULL])), ',')"
    base = "list_concat(" * (len(BASE) - 1) + "s0" + "".join(f", s{k})" for k in range(1, len(BASE)))
    shares = [f"({' + '.join(f'CAST({stands(p)} AS INTEGER)' for p in (*must, *may))}) / {float(len(must) + len(may))}" for _, must, may in MORE]
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, {arrays} FROM words)
SELECT doc_id, n_words, CAST(len({base}) AS BIGINT) AS n_base, CAST(list_min({base}) AS BIGINT) AS first_word, CAST(list_max({base}) AS BIGINT) AS last_word,
       {listed(named)} AS base_labels, {listed(named + given)} AS labels, CAST(greatest(CASE WHEN len({base}) > 0 THEN 1.0 ELSE 0.0 END, {', '.join(shares)}) AS DOUBLE) AS score
FROM found
"""
