"""Flags of stored cards: each rule by hand, all rules over the tables, nothing new on a second run."""

import pytest
from pyspark.sql import functions as F

from lodeweave.operators.reconcile import reconciled
from lodeweave.plans import papers
from lodeweave.plans.registry import Env

CARD = "paper_id long, card_id long, state string, flags array<string>, kind string, stem string, options map<string,string>, analysis string, origin string, anchor_seq int, approved boolean, edited boolean, checked boolean"
FIGURE = "paper_id long, card_id long, page int, x0 double, y0 double, x1 double, y1 double, source string, slot string"
REGION = "paper_id long, card_id long, page int, x0 double, y0 double, x1 double, y1 double"
BLOCK = "paper_id long, seq int, page int, x0 double, y0 double, x1 double, y1 double, text string"


def card(k, **c):
    row = {"state": "green", "flags": [], "kind": "free", "stem": "x", "options": None, "analysis": None, "origin": None, "anchor_seq": None, "approved": False, "edited": False, "checked": False} | c
    return (1, k, *row.values())


@pytest.fixture
def run(spark):
    def f(cards, figures=(), regions=(), blocks=(), again=True):
        tables = [spark.createDataFrame(list(rows), schema) for rows, schema in ((figures, FIGURE), (regions, REGION), (blocks, BLOCK))]
        out = reconciled(spark.createDataFrame(cards, CARD), *tables)
        rows = out.collect()
        if again:
            twice = reconciled(spark.createDataFrame([tuple(r)[:-1] for r in rows], CARD), *tables).collect()
            assert not any(r["changed"] for r in twice)
        return {r["card_id"]: (r["flags"], r["state"], r["changed"]) for r in rows}

    return f


def test_places_and_slots(run):
    fig = lambda k, slot: (1, k, 0, 0.0, 0.0, 9.0, 9.0, "auto", slot)
    got = run(
        [card(1, kind="fill_blank", stem="求它的值"), card(2, kind="fill_blank", stem="它是____"), card(3, kind="fill_blank", approved=True), card(4, flags=None), card(5), card(6, options={"A": "1"}), card(7, kind="single_choice"), card(8, kind="fill_blank", stem=None, state="red")],
        [fig(5, "A"), fig(6, "A"), fig(7, "B"), fig(4, "stem")],
    )
    assert got[1] == (["fill_without_slot"], "yellow", True) and got[8] == (["fill_without_slot"], "red", True)
    assert got[5] == (["slotted_non_choice"], "yellow", True)
    assert all(got[k] == ([], "green", False) for k in (2, 3, 4, 6, 7))


def test_figures_outside(run):
    at = lambda k, y, source: (1, k, 0, 100.0, y, 200.0, y + 100, source, None)
    regions = [(1, k, 0, 50.0, 0.0, 500.0, 200.0) for k in range(1, 7)]
    got = run([card(1), card(2), card(3), card(4, flags=["row_figure"]), card(5), card(6)], [at(1, 400.0, "other"), at(2, 100.0, "row"), at(3, 400.0, "auto"), at(4, 400.0, "row"), at(5, 400.0, "shared"), at(5, 0.0, "manual"), at(6, 160.0, "shared")], regions)
    assert {k for k, v in got.items() if v[2]} == {1} and got[1][0] == ["outside_range"]
    assert got[4] == (["row_figure"], "green", False)


def test_anchors(run):
    blocks = [(1, 1, 0, 0.0, 0.0, 9.0, 9.0, "4. 如果一个三角形两边的长分别等于 3"), (1, 2, 0, 0.0, 0.0, 9.0, 9.0, "（2025届某地某校开学考试题）7. 矩形土地上要建造花园 8. 另一道题目的文字在此")]
    other, same = "在一块矩形土地上建造", "若三角形两边的\n长分别是"
    got = run([card(1, anchor_seq=1, stem=other), card(2, anchor_seq=1, stem=same), card(3, anchor_seq=2, stem=other), card(4, anchor_seq=1, stem=same, flags=["anchor_mismatch", "odd"], state="yellow"), card(5, anchor_seq=1, stem=same, flags=["anchor_mismatch"], state="yellow", checked=True), card(6, anchor_seq=1, stem=same, flags=["anchor_mismatch"], state="yellow", edited=True), card(7, anchor_seq=9, stem=other)], blocks=blocks)
    assert got[1] == (["anchor_mismatch"], "yellow", True)
    assert all(got[k] == ([], "green", False) for k in (2, 3, 7))
    assert got[4] == (["odd"], "yellow", True) and got[5] == ([], "green", True) and got[6] == (["anchor_mismatch"], "yellow", False)


def test_captions(run):
    fig = lambda k, x: (1, k, 0, x, 100.0, x + 200, 300.0, "auto", None)
    line = lambda seq, x, y, text: (1, seq, 0, x, y, x + 60, y + 10, text)
    blocks = [line(1, 150.0, 310.0, "图 4-1"), line(2, 550.0, 310.0, "图4—2"), line(3, 150.0, 250.0, "图 5-1"), line(4, 150.0, 420.0, "图 6-1"), line(5, 150.0, 310.0, "如图 7-1 中")]
    got = run([card(1, stem="图 4-1 中"), card(2, stem="图 4.1 与图 4-2"), card(3, stem="图 5-1"), card(4, stem="图 6-1"), card(5, stem="图 7-1"), card(6, stem="如图")], [fig(k, 100.0) for k in range(1, 7)] + [fig(2, 500.0)], blocks=blocks)
    assert got[1] == (["caption_cut:4-1"], "green", True) and got[2] == (["caption_cut:4-1,4-2"], "yellow", True)
    assert not any(got[k][2] for k in (3, 4, 5, 6))


def test_second_columns(run):
    region = lambda k, x0, y0: (1, k, 0, x0, y0, x0 + 400, y0 + 100)
    blocks = [(1, 1, 0, 520.0, 20.0, 900.0, 40.0, "（2）x （4）y"), (1, 2, 0, 520.0, 220.0, 900.0, 240.0, "(2) z"), (1, 3, 0, 520.0, 520.0, 900.0, 540.0, "(2) far")]
    stem = "解方程\n（1）a\n（3）b"
    got = run([card(1, stem=stem), card(2, stem=stem), card(3, stem="(2) z"), card(4, stem="(1) a\n(2) b"), card(5, stem="y_(1) and y_(3)")], regions=[region(1, 100.0, 0.0), region(2, 100.0, 200.0), region(3, 510.0, 200.0), region(4, 100.0, 0.0), region(5, 100.0, 0.0)], blocks=blocks)
    assert got[1] == (["subitem_gap:2,4"], "yellow", True)
    assert not any(got[k][2] for k in (2, 3, 4, 5))


def test_tables(spark, sf):
    cards, figures, regions, blocks = papers.stored_cards(Env(spark, sf))
    once = reconciled(cards, figures, regions, blocks)
    flags = {r[0].split(":")[0] for r in once.where("changed").select(F.explode("flags")).collect()}
    assert once.count() == cards.count() and {"outside_range", "anchor_mismatch", "fill_without_slot", "subitem_gap", "caption_cut", "slotted_non_choice"} <= flags


def test_shortcuts(run):
    """A reading with the whole printed line agrees; where a task word is left out, prose that only its two sides make is compared."""
    text = lambda seq, t: (1, seq, 0, 0.0, 0.0, 9.0, 9.0, t)
    lines = ["4. 某校某次运动会共有甲班参加", "5. 甲乙丙如图，丁戊己"]
    blocks = [text(1, lines[0]), text(2, lines[1])]
    got = run([card(1, anchor_seq=1, stem="见 " + lines[0] + "\n(1) a"), card(2, anchor_seq=2, stem=lines[1]), card(3, anchor_seq=2, stem="甲乙丙丁戊己"), card(4, anchor_seq=1, stem=None, analysis=lines[0])], blocks=blocks)
    assert got[2] == (["anchor_mismatch"], "yellow", True)
    assert not any(got[k][2] for k in (1, 3, 4))


def test_plan(spark, sf):
    """No arrays of boxes: the plan sums and joins rows, and the line of a card is compared in one place."""
    plan = reconciled(*papers.stored_cards(Env(spark, sf)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set(") == 2 and plan.count("compact") + plan.count("array_sort(") <= 2
    assert plan.count("如图所示|") == 1
