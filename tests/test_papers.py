"""Exam papers and textbooks: single rules by hand, whole analyses against plain sequential versions."""

import random
import re

import pytest

from lodeweave.operators import exam, segmentation, textbook
from lodeweave.plans import papers
from lodeweave.plans.registry import Env

BLOCK = "paper_id long, seq int, page int, x0 double, y0 double, x1 double, y1 double, type string, text string"


def blocks_of(spark, texts, **kinds):
    """One paper of full-width blocks, one below the other."""
    return spark.createDataFrame([(1, i, i // 10, 60.0, i % 10 * 90.0, 900.0, i % 10 * 90.0 + 60, kinds.get(f"b{i}", "text"), t) for i, t in enumerate(texts)], BLOCK)


def by_paper(rows):
    out = {}
    for r in rows:
        out.setdefault(r["paper_id"], []).append(r)
    return out


# ---- plain versions


def plain_lines(xs_by_page, blocks):
    """Lines between columns, page by page, from the margins of starts."""

    def margins(xs):
        out = []
        for x in sorted(xs):
            if not out or x - out[-1][-1] > 120:
                out.append([])
            out[-1].append(x)
        return [g[0] for g in out]

    whole = margins([x for xs in xs_by_page.values() for x in xs])
    lines = {}
    for page in {b["page"] for b in blocks}:
        own = margins(xs_by_page.get(page, []))
        boxes = [b for b in blocks if b["page"] == page and b["type"] not in exam.FURNITURE]
        for m in (own if len(own) > 1 else whole)[1:]:
            at = max(0.0, m - 15)
            left = sum((b["x0"] + b["x1"]) / 2 < at for b in boxes)
            cross = sum(b["x0"] < at - 8 and b["x1"] > at + 8 for b in boxes)
            if 250 <= at <= 750 and len(boxes) >= 3 and 1 <= left < len(boxes) and cross <= max(2, 0.15 * len(boxes)):
                lines.setdefault(page, []).append(at)
    return {p: sorted(set(v)) for p, v in lines.items()}


def column(lines, page, x):
    return sum(x >= at for at in lines.get(page, []))


def plain_chain(rows):
    """The best rising chain by the square of their number."""
    sums, back = [], []
    for i, r in enumerate(rows):
        value, before = round(r["score"] - min(3.0, 0.15 * (r["number"] - 1)), 9), -1
        for j in range(i):
            if rows[j]["number"] < r["number"]:
                with_j = round(sums[j] + r["score"] - 1.2 * (r["number"] - rows[j]["number"] - 1), 9)
                if with_j > value:
                    value, before = with_j, j
        sums.append(value)
        back.append(before)
    i = max(range(len(rows)), key=lambda k: (sums[k], -k), default=-1)
    out = []
    while i >= 0:
        out.append(rows[i])
        i = back[i]
    return out[::-1]


def plain_exam(found, heads, blocks):
    """Starts of one paper: (number, seq, source), from its candidates."""
    xs = {}
    sure = [c for c in found if c["source"] == "read" and c["at_start"] and c["score"] >= 3]
    for c in sure or [c for c in found if c["source"] == "read"]:
        xs.setdefault(c["page"], []).append(c["x"])
    lines = plain_lines(xs, blocks)

    def key(c, lines=None):
        return (c["page"], column(lines, c["page"], c["x"] + 1), c["y"])

    sections = sorted(key(h, lines) for h in heads if h["kind"] == "heading" and h["text"].startswith("一"))
    if sections and any(c["source"] == "read" and c["number"] == 1 and key(c, lines) > sections[0] for c in found):
        found = [c for c in found if c["source"] != "read" or key(c, lines) > sections[0]]

    def chain(lines):
        return plain_chain(sorted((c for c in found if c["source"] == "read" and c["number"] > 0), key=lambda c: (*key(c, lines), c["seq"], c["number"])))

    picked = chain(lines)
    if len(picked) >= 3:
        xs = {}
        for c in picked:
            xs.setdefault(c["page"], []).append(c["x"])
        lines = plain_lines(xs, blocks)
        picked = chain(lines)
    out = [(c["number"], c["seq"], "read") for c in picked]
    for a, b in zip(picked, picked[1:]):
        between = sorted((c for c in found if key(a, lines) < key(c, lines) < key(b, lines)), key=lambda c: (*key(c, lines), c["seq"], c["number"]))
        got, after = {}, None
        for n in range(a["number"] + 1, b["number"]):
            fits = [c for c in between if c["source"] == "read" and c["at_start"] and (after is None or key(c, lines) > after) and c["number"] != n and str(n).endswith(str(c["number"]))]
            if len(fits) == 1:
                got[n], after = fits[0], key(fits[0], lines)
        for n in range(a["number"] + 1, b["number"]):
            same = [c for c in between if c["source"] == "bare" and c["number"] == n and c["seq"] not in [g["seq"] for g in got.values()]]
            if n not in got and len(same) == 1:
                got[n] = same[0]
        rest = [n for n in range(a["number"] + 1, b["number"]) if n not in got]
        free = [c for c in between if c["source"] == "unnumbered" and c["seq"] not in [g["seq"] for g in got.values()]]
        if rest and len(rest) == len(free):
            trial = got | dict(zip(rest, free))
            places = [key(trial[n], lines) for n in sorted(trial)]
            if places == sorted(places) and len(set(places)) == len(places):
                got = trial
        out += [(n, c["seq"], "repaired") for n, c in got.items()]
    return sorted(out), lines


def plain_book(found, blocks):
    """Roles of one book's markers: (seq, role, number), by an automaton."""

    def lines_of(items):
        xs = {}
        for m in items:
            xs.setdefault(m["page"], []).append(m["x"])
        return plain_lines(xs, blocks)

    lines = lines_of([m for m in found if m["kind"] in ("example_start", "numbered")])
    place = lambda m: (m["page"], column(lines, m["page"], m["x"] + 1), m["y"], m["seq"], m["kind"])
    state, out = set(), []
    for m in sorted(found, key=place):
        k, role = m["kind"], m["kind"]
        body = re.sub(textbook._NUMBERED, r"\2", m["text"].replace("**", "").strip()).strip() if re.match(textbook._NUMBERED, m["text"].replace("**", "")) else ""
        strong = bool(re.search(textbook._ASKS_STRONGLY, body))
        if k == "practice_header":
            state = {"practice"}
        elif k == "column_header":
            state &= {"practice"}
        elif k == "choice_bundle_header":
            state, role = {"choices"}, "section_heading"
        elif k == "procedure_intro":
            state, role = {"procedure"}, "section_heading"
        elif k == "example_start":
            state, role = set(), "example"
        elif k == "context_question":
            state, role = set(), "exercise"
        elif k == "section_heading":
            state = {"instructions"} if "信息技术应用" in m["text"] else set()
        elif k == "non_card_numbered":
            state, role = state - {"practice", "choices"}, "section_heading"
        elif k == "parenthesized":
            role = "exercise" if "choices" in state and m["asks"] else None
        elif k == "numbered":
            state.discard("choices")
            short = body and len(body) <= 24 and not m["asks"] and body[-1] not in "：:？?"
            if "procedure" in state or "instructions" in state and not strong:
                role = "section_heading"
            elif "practice" in state:
                role = "exercise"
            elif short or not body:
                role = "section_heading"
            else:
                role = "exercise"
                state.discard("instructions")
        elif k == "example_reference":
            role = None
        if role:
            out.append((place(m), m["seq"], role, m["number"]))
    cards = [x for x in out if x[2] == "exercise"]
    for (a, i, _, n), (b, j, _, k) in zip(cards, cards[1:]):
        if a[:2] == b[:2] and n is not None and k == n + 2 and 2 <= j - i <= 40:
            inside = [x for x in blocks if x["page"] == a[0] and i < x["seq"] < j and x["type"] not in exam.FURNITURE]
            asking = [x for x in inside if x["type"] not in (*exam.PICTURES, "equation") and re.search("[?？]", x["text"] or "") and re.search(textbook._ASKS, x["text"]) and not re.match(textbook._NUMBERED, x["text"].strip())]
            tables = [x for x in inside if x["type"] == "table" and asking and x["seq"] < asking[0]["seq"]]
            if len(asking) == 1 and tables:
                out.append((a, max(x["seq"] for x in tables), "exercise", n + 1))
    return sorted((s, r, n or 0) for _, s, r, n in out)


# ---- whole analyses over the tables


@pytest.fixture(scope="module")
def env(spark, sf):
    return Env(spark, sf)


def test_exam_equals_plain_version(env):
    blocks = papers.exam_blocks(env).cache()
    layout = exam.analyse(blocks)
    found = by_paper(exam.without_notices(exam.starts(blocks), blocks).collect())
    heads, of, got, lines = by_paper(exam.headings(blocks).collect()), by_paper(blocks.collect()), by_paper(layout.starts.collect()), by_paper(layout.lines.collect())
    assert len(of) > 150 and sum(any(r["source"] == "repaired" for r in rows) for rows in got.values()) > 30 and len(lines) > 80
    for paper, rows in of.items():
        wanted, at = plain_exam(found.get(paper, []), heads.get(paper, []), rows)
        assert sorted((r["number"], r["seq"], r["source"]) for r in got.get(paper, [])) == wanted, paper
        assert {r["page"]: r["lines"] for r in lines.get(paper, [])} == at, paper
    # slots hold all content once, regions lie inside slots and hold their start
    slots = layout.slots.collect()
    inside = {(s["paper_id"], s["page"], s["col"]): s for s in slots}
    assert len(inside) == len(slots)
    for paper, rows in of.items():
        at = {r["page"]: r["lines"] for r in lines.get(paper, [])}
        for b in rows:
            if b["type"] not in exam.FURNITURE:
                s = inside[paper, b["page"], column(at, b["page"], (b["x0"] + b["x1"]) / 2)]
                assert s["top"] <= b["y0"] and s["bottom"] >= b["y1"]
    boxes = by_paper(exam.regions(layout).collect())
    for paper, rows in got.items():
        for r in rows:
            mine = [b for b in boxes.get(paper, []) if b["seq"] == r["seq"] and b["number"] == r["number"]]
            first = min(mine, key=lambda b: b["slot"], default=None)
            if first is not None and first["page"] == r["page"]:
                assert first["y0"] <= r["y"] + 0.1


def test_book_equals_plain_automaton(env):
    blocks = papers.book_blocks(env).cache()
    book = textbook.analyse(blocks)
    found, of = by_paper(textbook.markers(blocks).collect()), by_paper(blocks.collect())
    got = {}
    for r in book.starts.collect():
        got.setdefault(r["paper_id"], []).append((r["seq"], r["source_kind"], r["number"]))
    for r in book.boundaries.collect():
        got.setdefault(r["paper_id"], []).append((r["seq"], r["kind"]))
    assert len(of) > 150
    for paper, rows in of.items():
        wanted = [(s, r, n) if r in ("example", "exercise") else (s, r) for s, r, n in plain_book(found.get(paper, []), rows)]
        assert sorted(got.get(paper, []), key=str) == sorted(wanted, key=str), paper


# ---- single rules


def test_starts_of_odd_blocks(spark):
    texts = ["1. 如图", "A. 3\n2．设 x", "见 3.5 与 x4. 的值", "0. 如图", "（本题满分 12 分）求", "14 如图", "9若", "3个数", None, "", "<sub>12.</sub> <sub>已知</sub>", "7.= 3", "5、(10分) 求", "[4.如"]
    found = {(r.seq, r.number, r.source): r for r in exam.starts(blocks_of(spark, texts, b11="equation")).collect()}
    assert set(found) == {(0, 1, "read"), (1, 2, "read"), (3, 0, "read"), (4, 0, "unnumbered"), (5, 14, "bare"), (6, 9, "bare"), (10, 12, "read"), (11, 7, "read"), (12, 5, "read"), (13, 4, "read")}
    score = {k[0]: (r.score, r.at_start) for k, r in found.items()}
    assert score == {0: (4.0, True), 1: (2.0, False), 3: (0.2, True), 4: (0.5, True), 5: (0.5, True), 6: (0.5, True), 10: (4.0, True), 11: (1.5, True), 12: (5.5, True), 13: (2.0, False)}
    assert found[1, 2, "read"].y == 90 + 24 and found[1, 2, "read"].offset == 5
    assert exam.starts(blocks_of(spark, texts).limit(0)).collect() == []


def test_notices_and_sections(spark):
    texts = ["注意事项：1. 答题前填写", "2. 用 2B 铅笔", "3. 已知 x", "1. 在试卷上", "一、选择题", "1. 如图", "2. 如图 A. 4", "D. 3\n3. 若", "二、填空题", "4. 求"]
    blocks = blocks_of(spark, texts)
    kept = exam.without_notices(exam.starts(blocks), blocks).collect()
    assert sorted(r.seq for r in kept if r.source == "read") == [2, 3, 5, 6, 7, 9]
    layout = exam.analyse(blocks)
    assert sorted((r.number, r.seq) for r in layout.starts.collect()) == [(1, 5), (2, 6), (3, 7), (4, 9)]
    got = {r.number: (r.section, r.text) for r in exam.questions(blocks, layout).collect()}
    assert got == {1: ("一、选择题", "1. 如图"), 2: ("一、选择题", "2. 如图 A. 4\nD. 3"), 3: ("一、选择题", "3. 若"), 4: ("二、填空题", "4. 求")}
    boxes = {r.number: (r.y0, r.y1) for r in exam.regions(layout).collect()}
    assert boxes[4][0] == 801.0 and boxes[3][1] == 718.0 and boxes[1] == (441.0, 538.0)
    only = blocks_of(spark, texts[:2])  # all are instructions: none goes
    assert len(exam.without_notices(exam.starts(only), only).collect()) == 2


def test_two_columns(spark):
    rows = [(1, k, 0, 60.0 if k < 4 else 540.0, k % 4 * 200.0, 460.0 if k < 4 else 940.0, k % 4 * 200.0 + 100, "text", f"{k + 1}. 如图") for k in range(8)]
    rows += [(1, 8, 1, 60.0, 0.0, 940.0, 100.0, "text", "9. 如图"), (1, 9, 1, 60.0, 200.0, 940.0, 300.0, "text", "10. 如图"), (1, 10, 1, 60.0, 400.0, 940.0, 500.0, "text", "11. 如图"), (2, 0, 0, None, None, None, None, "text", None)]
    layout = exam.analyse(spark.createDataFrame(rows, BLOCK))
    assert [(r.page, r.lines) for r in layout.lines.collect()] == [(0, [525.0])]  # the second page is crossed
    assert sorted((r.number, r.page, r.col) for r in layout.starts.collect()) == [(k + 1, 0, int(k > 3)) for k in range(8)] + [(9, 1, 0), (10, 1, 0), (11, 1, 0)]
    assert [(r.slot, r.page, r.col, r.x0, r.x1) for r in layout.slots.orderBy("slot").collect()] == [(0, 0, 0, 40.0, 525.0), (1, 0, 1, 525.0, 960.0), (2, 1, 0, 40.0, 960.0)]
    boxes = sorted((r.number, r.slot, r.y0, r.y1) for r in exam.regions(layout).collect())
    assert boxes[3:5] == [(4, 0, 591.0, 704.0), (5, 1, 0.0, 198.0)]


KINDS = [
    ("例 3. 已知 x", ["example_start"], 3), ("例十五：", ["example_start"], 15), ("例3中的结果", ["example_reference"], 3), ("Example 2: find", ["example_start"], 2), ("例如", [], None),
    ("练习", ["practice_header"], None), ("课后习题 4.2：", ["practice_header"], None), ("练习一下", [], None), ("3. 选择题", ["choice_bundle_header"], None), ("解：由", ["analysis_solution"], None), ("证明 下面", [], None),
    ("Solution: x", ["analysis_solution"], None), ("解法二", ["analysis_solution"], None), ("由此。解：x", ["analysis_solution"], None), ("一、集合", ["section_heading"], None), ("4.2 函数", ["section_heading"], None), ("第二章", ["section_heading"], None),
    ("思考", ["section_heading"], None), ("步骤如下：", ["procedure_intro"], None), ("（1）求 x", ["parenthesized"], 1), ("（1）", [], None), ("3. 求 x", ["numbered"], 3), ("※3. 求 x", ["numbered"], 3), ("**3.** 求 x", ["numbered"], 3),
    ("3. 建立模型", ["non_card_numbered"], 3), ("那么。4. 求 x 的值？", ["embedded_question_end", "numbered"], 4), ("在 4.2.1 的问题 1 中", [], None), ("做一做", ["column_header"], None), ("**做一做**", ["column_header"], None), ("那么", [], None), (None, [], None), ("0. 求", [], None),
]


def test_markers_by_hand(spark):
    # apart, so that no line is another's neighbour
    rows = [(i, 1, 0, 60.0, 100.0, 900.0, 160.0, "text", t) for i, (t, *_) in enumerate(KINDS)]
    got = by_paper(textbook.markers(spark.createDataFrame(rows, BLOCK)).collect())
    for i, (text, kinds, number) in enumerate(KINDS):
        found = got.get(i, [])
        assert sorted(r["kind"] for r in found) == kinds, text
        assert number is None or [r["number"] for r in found if r["number"] is not None] == [number], text
    height = [r["y"] for r in got[[t for t, *_ in KINDS].index("那么。4. 求 x 的值？")] if r["kind"] == "numbered"]
    assert height == [pytest.approx(100 + 60 * 3 / 13)]
    formula = textbook.markers(spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 9.0, 10.0, "equation", "x \\text{解：} y"), (1, 2, 0, 0.0, 0.0, 9.0, 10.0, "equation", "3. 求")], BLOCK)).collect()
    assert [(r.kind, r.seq, round(r.y, 3)) for r in formula] == [("analysis_solution", 1, 1.538)]


def test_panels_stages_and_lost_numbers(spark):
    texts = ["思考", "问题 二 中为什么？", "1. 观察实际情景，发现和提出问题", "一段话", "已知水温，求时间？", "练习", "1. 求 x 的值", "表", "求 y 的值？", "3. 求 z 的值"]
    book = textbook.analyse(blocks_of(spark, texts, b7="table"))
    assert sorted((r.seq, r.number, r.source_kind) for r in book.starts.collect()) == [(1, 2, "exercise"), (4, 1, "exercise"), (6, 1, "exercise"), (7, 2, "exercise"), (9, 3, "exercise")]
    plain = textbook.analyse(blocks_of(spark, texts))  # no table, no anchor
    assert 7 not in [r.seq for r in plain.starts.collect()]


def test_solutions_end_examples_only(spark):
    texts = ["例 1 求 x 的值", "还有一行", "解：x 是 3", "x", "练习", "1. 求 y 的值", "解：算出来的", "2. 求 z 的值"]
    blocks = blocks_of(spark, texts)
    book = textbook.analyse(blocks)
    layout = exam.Layout(book.starts, book.slots, textbook.stops(blocks, book), book.lines)
    got = {(r.seq, r.number): r.text for r in exam.questions(blocks, layout).collect()}
    assert got == {(0, 1): "例 1 求 x 的值\n还有一行", (5, 1): "1. 求 y 的值\n解：算出来的", (7, 2): "2. 求 z 的值"}
    assert {r.number for r in exam.regions(layout).collect()} == {1, 2}


def test_random_streams(spark):
    """Marker streams of many short books, so that every state meets every kind."""
    dice = random.Random(3)
    texts = [t for t, kinds, _ in KINDS if t and kinds] + ["信息技术应用", "2. 打开软件然后按下按钮再拖动一个点看看会发生什么样的变化", "5. 单调性", "6. 计算", "（2）求 x？"]
    rows = [(p, i, 0, 60.0, i * 40.0, 900.0, i * 40.0 + 30, "text", dice.choice(texts)) for p in range(400) for i in range(dice.randint(1, 14))]
    blocks = spark.createDataFrame(rows, BLOCK)
    of, found = by_paper(blocks.collect()), by_paper(textbook.markers(blocks).collect())
    book = textbook.analyse(blocks)
    got = {}
    for r in book.starts.collect():
        got.setdefault(r["paper_id"], []).append((r["seq"], r["source_kind"]))
    for r in book.boundaries.collect():
        got.setdefault(r["paper_id"], []).append((r["seq"], r["kind"]))
    for p, b in of.items():
        assert sorted(got.get(p, [])) == sorted((s, r) for s, r, _ in plain_book(found.get(p, []), b)), p


# ---- first questions that lost their number


def plain_leading(starts, heads, lines, blocks):
    """(status, first number, seq, score) of one paper, block by block."""
    at = lambda page, x: column(lines, page, x)
    ordered = sorted((s["page"], s["col"], s["y"], s["number"]) for s in starts)
    if not ordered or ordered[0][3] <= 1:
        return None
    until, number = ordered[0][:3], ordered[0][3]
    above = sorted(((h["page"], h["col"], h["y"]), h["text"]) for h in heads if h["kind"] == "heading" and (h["page"], h["col"], h["y"]) < until)
    section = next((k for k, t in above if re.match(r"一\s*[、.．]", t.strip())), None)
    cut = section or (above[-1][0] if above else None)
    front = sorted(((b["page"], at(b["page"], (b["x0"] + b["x1"]) / 2), b["y0"]), b["seq"], (b["text"] or "").strip(), b["type"]) for b in blocks if b["type"] not in (*exam.FURNITURE, *exam.PICTURES) and (b["text"] or "").strip())
    front = [f for f in front if f[0] < until and (cut is None or f[0] > cut)]
    if not front:
        return None
    cited = lambda t: re.sub(r"^\s*[\[【（(][^\]】）)]{1,96}[\]】）)]\s*", "", t, count=1)
    stem_at = lambda t: bool(re.match(r"已知|若|设|下列|如图|根据|阅读|观察|判断|计算|证明|求|关于|对于|在\S{0,24}[中上]", t))
    scored = []
    for i, (key, seq, text, kind) in enumerate(front):
        after = next((k for k, _ in above if k > key), until)
        support = "\n".join(f[2] for f in front[i : i + 10] if f[0] < after)
        if kind == "equation" or re.search(r"(?<![0-9.．A-Za-z\\^_{])[0-9]{1,2}\s*[.．、]{1,2}(?![0-9])", text) or re.match(exam.HEADING, text):
            scored.append((-100, False, False, key, seq))
            continue
        source = bool(re.match(r"[\[【（(]\s*(?:20[0-9]{2}|[0-9]{2,4}\s*年|[^\]】）)]{0,32}(?:高考|中考|联考|期中|期末|月考|模拟))", text))
        one = bool(re.match(r"1\s+[一-\u9fff]", text))
        body = cited(re.sub(r"^1\s+(?=[一-\u9fff])", "", text))
        if source and not stem_at(body):
            more = next((x.strip() for x in support.split("\n")[1:] if x.strip()), "")
            body = (body + "\n" + cited(more)).strip() if more else body
        stem, mark = stem_at(body), bool(re.search(r"[？?]|[（(]\s*[）)]|求|证明|计算|判断|选择|填空", body))
        option = bool(re.search(r"(?:^|\s)[A-Ea-e]\s*[.．、:]", text))
        parts = set(re.findall(r"(?m)^\s*[（(]\s*([12])\s*[)）]", support))
        score = 5 * source + 2 * stem + 2 * mark + 2 * option + (len(body) >= 18) + 2 * one + ("1" in parts) + (parts == {"1", "2"})
        if re.search(r"注意事项|答卷前|考试时间|满分|姓名|班级|考号|密封线|请将答案|选择题|填空题|解答题|参考公式|本题共\s*[0-9]+\s*小题|每小题\s*[0-9]+\s*分", text):
            score -= 8
        scored.append((score, stem and (source or mark or option or bool(parts)), source, key, seq))
    score, shaped, source, key, seq = min(scored, key=lambda x: (-x[0], x[3], x[4]))
    asked = next((x[3] for x in scored if x[1] and x[0] >= 0), None) if section else None
    if number == 2 and shaped and score >= 7 and (source or section is not None and key == asked):
        return "repaired", number, seq, score
    if shaped or score >= 4 or any(re.search(r"(?m)^\s*[（(]\s*[12]\s*[)）]", f[2]) for f in front):
        return "suspected", number, seq, score
    return None


def test_leading_questions_equal_plain_version(env):
    blocks = papers.headless_blocks(env).cache()
    layout = exam.analyse(blocks)
    of, starts, heads, lines = by_paper(blocks.collect()), by_paper(layout.starts.collect()), by_paper(layout.headings.collect()), by_paper(layout.lines.collect())
    got = {r.paper_id: (r.status, r.first_number, r.seq, r.score) for r in exam.leading(blocks, layout).collect()}
    seen = []
    for paper, rows in of.items():
        wanted = plain_leading(starts.get(paper, []), heads.get(paper, []), {r["page"]: r["lines"] for r in lines.get(paper, [])}, rows)
        assert got.get(paper) == wanted, paper
        seen.append(wanted and wanted[0])
    assert min(seen.count(k) for k in ("repaired", "suspected", None)) > 5
    more = exam.with_leading(blocks, layout).starts
    assert more.where("source = 'inferred'").count() == seen.count("repaired") and more.count() == layout.starts.count() + seen.count("repaired")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_markers_deal_blocks_out_once(spark):
    found = plan(textbook.markers(spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 9.0, 10.0, "text", "1. 求 x")], BLOCK)))
    assert found.count("Exchange hashpartitioning") == 1 and "Join" not in found


def test_starts_are_chained_once(spark):
    layout = exam.analyse(spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 9.0, 10.0, "text", "1. 求 x")], BLOCK))
    assert [r.number for r in layout.starts.collect()] == [1]
    assert "MapInPandas" not in plan(layout.starts) and "MapInPandas" not in plan(exam.regions(layout))


def test_settled_tables_are_read_by_column(spark):
    from lodeweave.operators.taxonomy import settled

    wide = settled(spark.createDataFrame([(1, "a", [(2, None)])], "k long, text string, more array<struct<x:int,y:string>>"))
    assert wide.collect()[0].more[0].y is None and "ReadSchema: struct<k:bigint>" in plan(wide.select("k"))


def test_tables_of_scores_and_options_are_numbered_once(env):
    assert not any("l_orderkey" in plan(df) for df in (*papers.score_tables(env), *papers.option_tables(env)))


def test_segments_are_dealt_out_by_paper_alone(env):
    env.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables are too large for it at scale
    try:
        shown = plan(segmentation.segment(papers.exam_blocks(env)))
    finally:
        env.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", shown)
    assert keys and all(k.startswith("paper_id") and "," not in k for k in keys), keys


def test_starts_and_headings_of_one_place(spark):
    """Starts that stand at one place end at the next other place; the lowest heading right above counts."""
    starts = spark.createDataFrame([(1, n, n, 0, 0, 10.0, y, 3.0, True, 0, "read") for n, y in ((1, 100.0), (2, 100.0), (3, 300.0))], "paper_id long, number int, seq int, page int, col int, x double, y double, score double, at_start boolean, offset int, source string")
    heads = spark.createDataFrame([(1, 9, 0, 0, 10.0, 70.0, 93.0, "heading", "一、"), (1, 8, 0, 0, 10.0, 80.0, 95.0, "subheading", "（一）"), (1, 7, 0, 0, 10.0, 60.0, None, "heading", "二、")], "paper_id long, seq int, page int, col int, x double, y double, bottom double, kind string, text string")
    slots = spark.createDataFrame([(1, 0, 0, 0, 0.0, 500.0, 40.0, 900.0), (1, 1, 1, 0, 0.0, 500.0, 40.0, 700.0)], "paper_id long, slot int, page int, col int, x0 double, x1 double, top double, bottom double")
    lines = spark.createDataFrame([], "paper_id long, page int, lines array<double>")
    got = exam.regions(exam.Layout(starts, slots, heads, lines)).collect()
    assert sorted((r.number, r.slot, r.page, r.y0, r.y1) for r in got) == [(1, 0, 0, 96.0, 298.0), (2, 0, 0, 96.0, 298.0), (3, 0, 0, 291.0, 900.0), (3, 1, 1, 40.0, 700.0)]
