"""Numbering scopes on cases by hand and against a plain reading of the rule; hedged calls at their limits."""

import random

from lodeweave.operators import segmentation
from lodeweave.streaming import jobs

START = "paper_id long, seq int, page int, column int, y double, number int, score double, at_start boolean"


def scopes(spark, starts, pages, repaired=None):
    starts = spark.createDataFrame(starts, START)
    pages = spark.createDataFrame(pages, "paper_id long, page int")
    repaired = spark.createDataFrame(repaired, "paper_id long, seq int") if repaired else None
    out = segmentation.numbering_scopes(pages, starts, repaired).orderBy("paper_id", "scope").collect()
    return [tuple(r) for r in out]


def read(paper, *numbers, page=lambda k: 0):
    """Starts far apart in one column, one a hundred units, all sure."""
    return [(paper, k, page(k), 0, k * 100.0, n, 3.0, True) for k, n in enumerate(numbers)]


def test_scopes_by_hand(spark):
    starts = read(1, 1, 2, 1, 2) + read(2, 16, 17, 2, 18) + read(3, 5, 6, 7, 6, 1, 2) + read(4, 1, 2, 3, 1, 2, page=lambda k: k)
    pages = [(1, 0), (1, 4), (2, 0), (3, 0), (4, 0), (4, 9), (5, 0)]
    assert scopes(spark, starts, pages) == [
        (1, 0, 1, 0, 0, None, 1),  # both stand on one page
        (1, 1, 1, 0, 4, 2, None),
        (2, 0, 16, 0, 0, None, None),  # the two is a part of 17
        (3, 0, 5, 0, 0, None, 3),  # a lone six opens nothing
        (3, 1, 1, 0, 0, 4, None),
        (4, 0, 1, 0, 2, None, 2),
        (4, 1, 1, 3, 9, 3, None),
    ]


def test_lines_read_twice_and_unsure_papers(spark):
    twice = [(1, 0, 0, 0, 0.0, 1, 3.0, True), (1, 1, 0, 0, 50.0, 1, 3.0, True), (1, 2, 0, 0, 100.0, 1, 3.0, True), (1, 3, 0, 1, 0.0, 7, 3.0, True)]
    # 50 units on it is the same line, another 50 on (100 from the one that counts) it is a restart.
    assert scopes(spark, twice, [(1, 0)]) == [(1, 0, 1, 0, 0, None, 1), (1, 1, 1, 0, 0, 2, None)]
    unsure = [(2, k, 0, 0, k * 100.0, n, 1.0, False) for k, n in enumerate((1, 2, 1, 3))] + [(2, 9, 0, 0, 900.0, None, 3.0, True), (2, 10, 0, 0, 950.0, 0, 3.0, True)]
    assert scopes(spark, unsure, [(2, 0)]) == [(2, 0, 1, 0, 0, None, None)]  # the chain 1, 2, 3
    repaired = read(3, 8, 9, 1, 2, 11)
    assert len(scopes(spark, repaired, [(3, 0)])) == 2
    assert len(scopes(spark, repaired, [(3, 0)], [(3, 2), (3, 3)])) == 1
    assert scopes(spark, [], [(1, 0)]) == []


def plain(numbers):
    """Runs of numbers, each cut off at the first restart of the rest."""
    runs, rest = [], list(numbers)
    while rest:
        kept, k = [rest[0]], 1
        while k < len(rest):
            n, most = rest[k], max(kept)
            if n > most or n > 3 and n not in kept:
                kept.append(n)
            elif not (k + 1 < len(rest) and rest[k + 1] in range(most + 1, most + 4)):
                break
            k += 1
        runs.append(kept)
        rest = rest[k:]
    joined = []
    for r in runs:
        if joined and len(r) == 1 and r[0] > 3:
            joined[-1] = joined[-1] + r
        else:
            joined.append(r)
    return [r[0] for r in joined]


def test_scopes_as_plainly_read(spark):
    rng = random.Random(5)
    papers = {p: [rng.choice((1, 2, 3, 4, 5, 6, 9)) for _ in range(rng.randint(1, 14))] for p in range(300)}
    got: dict[int, list[int]] = {}
    for row in scopes(spark, [s for p, numbers in papers.items() for s in read(p, *numbers)], [(p, 0) for p in papers]):
        got.setdefault(row[0], []).append(row[2])
    assert got == {p: plain(numbers) for p, numbers in papers.items()}


def test_hedged(spark):
    calls = [(18.0, True, 1.0, True, True), (18.5, True, 0.5, True, True), (40.0, True, 3.0, True, True), (40.0, True, 3.0, False, True), (40.0, False, 3.0, False, True), (40.0, True, 3.0, True, False), (5.0, False, 1.0, True, True)]
    df = spark.createDataFrame(calls, "first_s double, first_ok boolean, second_s double, second_ok boolean, spare boolean")
    got = [(r.hedged, r.answered_by, r.seconds) for r in jobs.hedged(df).collect()]
    assert got == [(False, "first", 18.0), (True, "first", 18.5), (True, "second", 21.0), (True, "first", 40.0), (True, None, 40.0), (False, "first", 40.0), (False, None, 5.0)]
    assert not any(r.hedged for r in jobs.hedged(df, 0).collect())
