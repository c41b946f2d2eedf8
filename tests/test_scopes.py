"""Numbering scopes of books and the names of their groups, against plain sequential versions and by hand."""

import re

import pytest
from test_papers import blocks_of, by_paper

from lodeweave.operators import exam, textbook
from lodeweave.plans import papers
from lodeweave.plans.registry import Env

DIGITS = dict(zip("一二三四五六七八九十", range(1, 11)))


def plain_scopes(cards, boundaries, blocks):
    """One book, card by card, then scope by scope."""
    key = lambda c: (c["page"], c["col"], c["y"], c["seq"])
    cards = sorted(cards, key=lambda c: (*key(c), c["number"]))
    runs, seen = [], []
    for c in cards:
        last = runs[-1][-1] if runs else None
        if last is None or c["source_kind"] != last["source_kind"] or (c["number"] <= max(seen) and (c["number"] in seen or c["number"] <= 3)):
            runs.append([])
            seen = []
        runs[-1].append(c)
        seen.append(c["number"])
    marks = [(key(b), b["kind"], b["seq"]) for b in boundaries if b["kind"] in ("practice_header", "section_heading")] + [(key(c), "example", c["seq"]) for c in cards if c["source_kind"] == "example"]
    starts = []
    for i, run in enumerate(runs):
        first, at = run[0], run[0]["seq"]
        above = [m for m in marks if m[0] < key(first)]
        if i and first["source_kind"] == "exercise" and above:
            _, kind, seq = max(above, key=lambda m: m[0])
            if kind == "practice_header" and seq > runs[i - 1][-1]["seq"]:
                at = seq
        starts.append(at)
    pages = [b["page"] for b in blocks if b["type"] not in exam.FURNITURE]
    out = []
    for i, run in enumerate(runs):
        then = runs[i + 1][0] if i + 1 < len(runs) else None
        last_page = max(pages) if then is None else then["page"] if then["page"] == run[-1]["page"] else then["page"] - 1
        first = run[0]
        out.append((i, first["source_kind"], first["number"], first["seq"], first["page"], min(pages) if i == 0 else first["page"], last_page, starts[i] if i else None, starts[i + 1] - 1 if then else None))
    return out


def plain_names(scopes, blocks):
    """Names from all titles before each anchor."""
    titles = []
    for b in sorted(blocks, key=lambda b: b["seq"]):
        if m := re.match(r"^\s*第\s*(\d{1,3}|[一二三四五六七八九十]{1,3})\s*([章篇])\s*(.{0,24}?)\s*$", b["text"] or ""):
            number = int(m[1]) if m[1].isdigit() else DIGITS[m[1]]
            if 0 < number < 100:
                titles.append((b["seq"], (number, m[2]), m[3].strip(" 　·-—:：、")))
    labels = {}
    for s in scopes:
        before = [t for t in titles if t[0] <= s[3]]
        if before:
            chapter = before[-1][1]
            name = max((t[2] for t in titles if t[1] == chapter), key=len)
            labels[s[0]] = f"第{chapter[0]}{chapter[1]}" + (f" {name}" if name else "") + " · " + {"example": "例题", "exercise": "习题"}[s[1]]
    out = {}
    for scope, label in sorted(labels.items()):
        same = [k for k, v in sorted(labels.items()) if v == label]
        out[scope] = f"{label} {same.index(scope) + 1}" if len(same) > 1 else label
    return out


@pytest.fixture(scope="module")
def books(spark, sf):
    blocks = papers.chapter_blocks(Env(spark, sf))
    return blocks, textbook.analyse(blocks)


def test_scopes_and_names_of_whole_tables(books):
    blocks, book = books
    found = textbook.scopes(blocks, book)
    got, of, cards, ends = by_paper(found.collect()), by_paper(blocks.collect()), by_paper(book.starts.collect()), by_paper(book.boundaries.collect())
    names = by_paper(textbook.group_names(blocks, found).collect())
    titled = numbered = 0
    for paper, rows in cards.items():
        wanted = plain_scopes(rows, ends.get(paper, []), of[paper])
        assert sorted(tuple(r)[1:] for r in got[paper]) == wanted
        titled += sum(w[7] is not None and w[7] != w[3] for w in wanted)
        called = plain_names(wanted, of[paper])
        assert {r["scope"]: r["name"] for r in names.get(paper, [])} == called
        numbered += any(v[-1].isdigit() for v in called.values())
    assert set(got) == set(cards) and titled > 5 and numbered > 5


def test_a_practice_title_opens_its_scope(spark):
    texts = ["第六章", "例1 已知 x，求它的值？", "因此它是 3", "例2 已知 y，求它的值？", "练习", "1. 已知 a，求它的值？", "2. 已知 b，求它的值？", "第6章 特殊平行四边形", "例1 已知 z，求它的值？"]
    blocks = blocks_of(spark, texts)
    found = textbook.scopes(blocks, textbook.analyse(blocks))
    got = sorted(map(tuple, found.select("scope", "source_kind", "seq_start", "seq_end", "anchor_seq").collect()))
    assert got == [(0, "example", None, 3, 1), (1, "exercise", 4, 7, 5), (2, "example", 8, None, 8)]
    names = {r["scope"]: r["name"] for r in textbook.group_names(blocks, found).collect()}
    assert names == {0: "第6章 特殊平行四边形 · 例题 1", 1: "第6章 特殊平行四边形 · 习题", 2: "第6章 特殊平行四边形 · 例题 2"}


def test_books_without_cards_or_titles(spark):
    prose = blocks_of(spark, ["那么 3 是一个数", None, ""])
    book = textbook.analyse(prose)
    assert textbook.scopes(prose, book).collect() == []
    assert textbook.group_names(prose, textbook.scopes(prose, book)).collect() == []
    plain = blocks_of(spark, ["练习", "1. 已知 a，求它的值？"])
    found = textbook.scopes(plain, textbook.analyse(plain))
    assert found.count() == 1 and textbook.group_names(plain, found).count() == 0
