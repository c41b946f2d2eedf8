"""Layout edits, pictures of options and matching of cards against plain versions."""

import math
import random
import re
from collections import Counter

import pytest

from lodeweave.operators import layout_edits, merge, option_figures, sequences
from lodeweave.plans import papers
from lodeweave.plans.registry import Env


@pytest.fixture(scope="module")
def env(spark, sf):
    return Env(spark, sf)


def grouped(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r.asDict(recursive=True))
    return out


# ---- edits


def plain_fold(ops):
    """The log with a copy of the whole paper at each step: (outcome, reason, revision, live cards), and the last state."""
    cards, revision, epoch, last, seen, out = {}, 0, 0, None, {}, []
    for op in ops:
        kind, src, tgt = op["kind"], op["sources"] or [], op["targets"] or []
        payload = (kind, src, op["seen"], tgt)

        def say(outcome, reason=None):
            out.append((op["op_id"], outcome, reason, revision, len(live())))

        def live(of=None):
            return {c: v for c, v in (cards if of is None else of).items() if v["live"]}

        if op["request"] in seen and op["request"] is not None:
            first, reached = seen[op["request"]]
            out.append((op["op_id"], "replayed", None, reached, len(live())) if first == payload else (op["op_id"], "refused", "request", revision, len(live())))
            continue
        problem, done, after = None, "applied", {c: dict(v) for c, v in cards.items()}
        sizes = {"regions": (1, 1, 1, 1), "renumber": (1, 1, 1, 1), "add": (0, 0, 1, 1), "split": (1, 1, 2, 12), "merge": (2, 12, 1, 1)}
        if kind == "edit":
            for c in src:
                if c in after:
                    after[c]["rev"] += 1
            done = "noted"
        elif kind == "pages":
            epoch, done = epoch + 1, "noted"
        elif op["expected"] is not None and op["expected"] != revision:
            problem = "stale"
        elif kind == "undo":
            done = "undone"
            if last is None:
                problem = "nothing"
            elif last["epoch"] != epoch:
                problem = "pages"
            elif last["revision"] != revision:
                problem = "later"
            elif any(cards[c]["rev"] != last["after"][c]["rev"] for c in last["touched"]):
                problem = "touched"
            else:
                for c in last["touched"]:
                    rev = cards[c]["rev"] + 1
                    after[c] = dict(last["before"][c], rev=rev) if c in last["before"] else dict(cards[c], rev=rev, live=False)
        elif kind not in sizes:
            problem = "kind"
        else:
            a, b, c, d = sizes[kind]
            gone = [x for x in src if x not in live()]
            if not (a <= len(src) <= b and c <= len(tgt) <= d):
                problem = "count"
            elif len(set(src)) < len(src):
                problem = "repeated"
            elif gone:
                problem = "missing"
            elif op["seen"] is not None and op["seen"] != [cards[x]["rev"] for x in src]:
                problem = "changed"
            elif len({cards[x]["group"] for x in src}) > 1:
                problem = "groups"
            elif kind != "renumber" and any(not t["regions"] or any(r["x0"] >= r["x1"] or r["y0"] >= r["y1"] or r["y1"] > 1000 or r["x1"] > 1000 or min(r["x0"], r["y0"], r["page"]) < 0 for r in t["regions"]) for t in tgt):
                problem = "regions"
            else:
                group = cards[src[0]]["group"] if src else None
                names = [(group if src else t["grp"], t["number"]) for t in tgt]
                others = [(v["group"], v["number"]) for x, v in live().items() if x not in src]
                if kind != "regions" and any(n is None or not 1 <= n <= 999 for _, n in names):
                    problem = "number"
                elif kind != "regions" and (len(set(names)) < len(names) or set(names) & set(others)):
                    problem = "taken"
                elif kind in ("regions", "renumber"):
                    field, value = ("number", tgt[0]["number"]) if kind == "renumber" else ("regions", tgt[0]["regions"])
                    if cards[src[0]][field] == value:
                        done = "unchanged"
                    else:
                        after[src[0]] |= {field: value, "rev": cards[src[0]]["rev"] + 1}
                else:
                    for x in src:
                        after[x] |= {"live": False, "rev": cards[x]["rev"] + 1}
                    for (g, n), t in zip(names, tgt):
                        after[len(after) + 1] = {"group": g, "number": n, "regions": t["regions"], "rev": 0, "live": True}
        if problem:
            say("refused", problem)
            continue
        if done in ("applied", "undone"):
            revision += 1
            touched = [c for c in after if after[c] != cards.get(c)]
            last = {"before": cards, "after": after, "touched": touched, "revision": revision if done == "applied" else -1, "epoch": epoch}
        cards = after
        if op["request"] is not None:
            seen[op["request"]] = (payload, revision)
        say(done)
    return out, {c: v for c, v in cards.items() if v["live"]}


def check_log(log):
    ops = grouped(log.orderBy("op_id").collect(), "paper_id")
    got, left = grouped(layout_edits.receipts(log).orderBy("op_id").collect(), "paper_id"), grouped(layout_edits.cards_after(log).collect(), "paper_id")
    outcomes = Counter()
    for paper, mine in ops.items():
        wanted, cards = plain_fold(mine)
        assert [(r["op_id"], r["outcome"], r["reason"], r["revision"], r["cards"]) for r in got[paper]] == wanted, paper
        assert {r["card"]: (r["number"], r["grp"], r["regions"], r["revision"]) for r in left.get(paper, [])} == {c: (v["number"], v["group"], v["regions"], v["rev"]) for c, v in cards.items()}
        outcomes.update((w[1], w[2]) for w in wanted)
    return outcomes


def test_edits_of_the_tables(env):
    outcomes = check_log(papers.edit_log(env))
    assert outcomes["applied", None] > 100 and {o for o, _ in outcomes} >= {"applied", "refused", "noted", "replayed"}


def test_random_logs(spark):
    dice = random.Random(11)
    box = lambda: {"page": 0, "x0": 0.0, "y0": float(dice.choice([10, 20, 500])), "x1": 10.0, "y1": float(dice.choice([30, 40, 400]))}
    rows = []
    for paper in range(120):
        for op in range(40):
            kind = dice.choice("add add add regions renumber split merge undo undo edit pages odd".split() if op > 3 else ["add"])
            sources = [dice.randint(1, 6) for _ in range({"add": 0, "undo": 0, "pages": 0, "merge": dice.choice([1, 2, 2, 3])}.get(kind, 1))] or None
            targets = [{"number": dice.choice([None, 0, *range(1, 30)]), "grp": dice.choice([None, 1, 1, 1]), "regions": [box()] if dice.random() < 0.95 else []} for _ in range({"split": dice.choice([1, 2, 2, 3])}.get(kind, 1))]
            rows.append((paper, op, dice.choice([None, None, f"r{dice.randint(0, 9)}"]), kind, dice.choice([None, None, None, dice.randint(0, 9)]), sources, [0] * len(sources) if sources and dice.random() < 0.2 else None, targets))
    rows.append((500, 1, None, "add", None, [], None, None))
    outcomes = check_log(spark.createDataFrame(rows, layout_edits.OPERATION).repartition(5))
    for reason in "request stale count repeated missing changed groups regions number taken kind nothing pages later touched".split():
        assert outcomes["refused", reason], reason
    assert outcomes["undone", None] > 20 and outcomes["unchanged", None] and outcomes["replayed", None]
    assert layout_edits.receipts(spark.createDataFrame([], layout_edits.OPERATION)).collect() == []


def test_a_long_log_takes_linear_time(spark):
    import time

    def log(n):
        one = [{"number": None, "grp": None, "regions": [{"page": 0, "x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 9.0}]}]
        return [(1, k, None, "add", None, None, None, [one[0] | {"grp": k, "number": 1}]) for k in range(n)]

    def seconds(n):
        df = spark.createDataFrame(log(n), layout_edits.OPERATION).cache()
        df.count()
        start = time.perf_counter()
        assert layout_edits.receipts(df).where("outcome = 'applied'").count() == n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16_000) < 20 * max(0.5, seconds(2_000))


# ---- pictures of options


def plain_marker(text):
    t = (text or "").translate(str.maketrans("（）．：ＡＢＣＤＥ　", "().:ABCDE ")).strip(" ")
    m = re.match(r"\(([A-E])\)(?=\s|$)|([A-E])\s*[.、:)](?=\s|$)", t)
    if m:
        return (m[1] or m[2], True) if not re.search(r"(?:^|\s)(?:\([A-E]\)|[A-E]\s*[.、:)])", t[m.end() :]) else None
    return (t, False) if t in list("ABCDE") else None


def plain_gap(m, c):
    mx, my, out = (m["x0"] + m["x1"]) / 2, (m["y0"] + m["y1"]) / 2, []
    cy, height, gap = (c["y0"] + c["y1"]) / 2, c["y1"] - c["y0"], c["x0"] - m["x1"]
    offs = []
    if c["y0"] - 20 <= my <= c["y0"] + min(60, height / 2):
        offs.append(abs(my - c["y0"]))
    if abs(my - cy) <= max(18, height / 4):
        offs.append(abs(my - cy))
    if offs and -2 <= gap <= 50:
        out.append(max(0, gap) + min(offs) / 2)
    if max(0, min(m["x1"], c["x1"]) - max(m["x0"], c["x0"])) >= 0.6 * min(m["x1"] - m["x0"], c["x1"] - c["x0"]):
        for apart, most in ((c["y0"] - m["y1"], 35), (m["y0"] - c["y1"], 30)):
            if 0 <= apart <= most:
                out.append(apart + 0.1 * abs(mx - (c["x0"] + c["x1"]) / 2))
    return min(out, default=None)


def plain_evidence(card, blocks, images):
    if card["kind"] not in ("single_choice", "multiple_choice"):
        return []
    proper = lambda b: b["page"] >= 0 and 0 <= b["x0"] < b["x1"] <= 1000 and 0 <= b["y0"] < b["y1"] <= 1000
    images = [i for i in images if proper(i)]
    auto = [i for i in images if not i["manual"] and i["label"]]
    valid = [i for i in auto if sum(j["label"] == i["label"] for j in auto) == 1]
    if not valid:
        return []
    marks = {}
    for b in sorted(blocks, key=lambda b: b["seq"]):
        m = plain_marker(b["text"]) if b["type"] == "text" and not b["manual"] and proper(b) and b["y1"] - b["y0"] <= 65 else None
        inside = any(i["page"] == b["page"] and min(i["x1"], b["x1"]) > max(i["x0"], b["x0"]) and min(i["y1"], b["y1"]) > max(i["y0"], b["y0"]) for i in images)
        if m and not inside and not (card["cue"] and m[0] in (card["written"] or [])):
            marks.setdefault((m[0], b["page"], b["x0"], b["y0"], b["x1"], b["y1"]), b | {"slot": m[0], "explicit": m[1]})
    marks = list(marks.values())
    marks = [m for m in marks if m["explicit"] or len({k["slot"] for k in marks}) > 1]
    out, claims = [], {}
    for m in marks:
        if sum(k["slot"] == m["slot"] for k in marks) > 1:
            out.append((None, m["slot"], m["seq"], "duplicate_marker"))
            continue
        near = sorted((g, i["label"], i) for i in valid if i["page"] == m["page"] and (g := plain_gap(m, i)) is not None)
        if len(near) > 1 and near[1][0] - near[0][0] < 12:
            out.append((None, m["slot"], m["seq"], "ambiguous"))
        elif near:
            claims.setdefault(near[0][1], []).append((m, near[0][2]))
    for label, some in claims.items():
        for m, i in some:
            free = i["role"] in (None, "", "stem", m["slot"])
            out.append((label, m["slot"], m["seq"], "several_markers" if len(some) > 1 else None if free else "disagrees" if i["role"] in list("ABCDE") else "protected"))
    return out


def check_evidence(tables):
    got = grouped(option_figures.evidence(*tables).collect(), "card")
    cards, blocks, images = tables[0].collect(), grouped(tables[1].collect(), "card"), grouped(tables[2].collect(), "card")
    reasons = Counter()
    for c in cards:
        wanted = plain_evidence(c.asDict(), blocks.get(c.card, []), images.get(c.card, []))
        assert sorted(((r["label"], r["slot"], r["seq"], r["reason"]) for r in got.get(c.card, [])), key=str) == sorted(wanted, key=str), c.card
        reasons.update(w[3] for w in wanted)
    return reasons


def test_option_evidence_of_the_tables(env):
    assert {None, "duplicate_marker", "protected", "disagrees"} <= set(check_evidence([t.cache() for t in papers.option_tables(env)]))


def test_option_evidence_of_crowded_cards(spark):
    dice = random.Random(4)
    cards, blocks, images = [], [], []
    for c in range(400):
        cards.append((c, dice.choice(["single_choice", "single_choice", "free"]), dice.random() < 0.3, dice.choice([None, ["A"], []])))
        for k in range(dice.randint(0, 5)):
            x, y = dice.randrange(20, 300, 20), dice.randrange(20, 200, 20)
            images.append((c, dice.choice(["f1", f"g{k}", None]) if dice.random() < 0.2 else f"h{k}", 0, float(x), float(y), x + dice.choice([30.0, 60.0]), y + dice.choice([20.0, 60.0]), dice.random() < 0.1, dice.choice([None, None, "stem", "B", "excluded"])))
        for k in range(dice.randint(1, 6)):
            x, y = dice.randrange(0, 300, 10), dice.randrange(0, 260, 10)
            blocks.append((c, k, 0, float(x), float(y), x + 12.0, y + 12.0, "text", False, dice.choice(["A.", "B.", "C.", "D", "E. text", "(A)"])))
    frames = [spark.createDataFrame(cards, "card long, kind string, cue boolean, written array<string>"), spark.createDataFrame(blocks, "card long, seq int, page int, x0 double, y0 double, x1 double, y1 double, type string, manual boolean, text string"), spark.createDataFrame(images, "card long, label string, page int, x0 double, y0 double, x1 double, y1 double, manual boolean, role string")]
    assert {None, "ambiguous", "duplicate_marker", "protected", "several_markers", "disagrees"} <= set(check_evidence(frames))


def test_option_markers_by_hand(spark):
    texts = {"A.": ("A", True), "(B)": ("B", True), "C": ("C", False), "Ｄ．": ("D", True), "A. x B. y": None, "Axe": None, "F.": None, "E、 text": ("E", True), None: None, "A\nB": None}
    rows = [(k, k, 0, 1.0, 1.0, 20.0, 20.0, "text", False, t) for k, t in enumerate(texts)] + [(90, 1, 0, 1.0, 1.0, 20.0, 90.0, "text", False, "A."), (91, 1, 0, 1.0, 1.0, 20.0, 20.0, "equation", False, "A."), (92, 1, 0, 1.0, 1.0, 20.0, 20.0, None, True, "A.")]
    got = {r.card: (r.slot, r.explicit) for r in option_figures.markers(spark.createDataFrame(rows, "card long, seq int, page int, x0 double, y0 double, x1 double, y1 double, type string, manual boolean, text string")).collect()}
    assert got == {k: v for k, v in enumerate(texts.values()) if v}


# ---- cards of two segmentations


def plain_match(stored, wanted):
    groups = {w["grp"] for w in wanted}
    only = groups.pop() if len(groups) == 1 else None
    used, out = set(), []
    for w in sorted(wanted, key=lambda w: w["item"]):
        rules = []
        at = lambda s: s["grp"] if s["grp"] is not None else only
        near = lambda s, w=w: w["kind"] in ("example", "exercise") or at(s) == w["grp"]
        if w["anchor"] is not None:
            rules.append([s for s in stored if near(s) and s["anchor"] == w["anchor"] and s["kind"] == w["kind"]])
            rules.append([s for s in stored if near(s) and s["anchor"] == w["anchor"]])
        if w["anchor"] is None or w["kind"] in ("unknown", "manual"):
            rules.append([s for s in stored if at(s) == w["grp"] and s["number"] == w["number"]])
        pick = None
        for some in rules:
            free = [s for s in some if s["card"] not in used]
            if free:
                pick = min(free, key=lambda s: (abs(s["place"] - w["place"]), s["deleted"], s["card"]))["card"]
                used.add(pick)
                break
        out.append((w["item"], pick))
    return out + [(None, s["card"]) for s in stored if s["card"] not in used]


def test_matching_equals_the_sequential_rule(env):
    stored, wanted = (t.cache() for t in papers.card_tables(env))
    got, old, new = grouped(merge.matched_cards(stored, wanted).collect(), "paper_id"), grouped(stored.collect(), "paper_id"), grouped(wanted.collect(), "paper_id")
    some = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else int(x)
    assert len(new) > 50
    for paper in old.keys() | new.keys():
        assert sorted(((some(r["item"]), some(r["card"])) for r in got[paper]), key=str) == sorted(plain_match(old.get(paper, []), new.get(paper, [])), key=str), paper
    ways = Counter(r["by"] for rows in got.values() for r in rows)
    assert min(ways[k] for k in ("anchor and kind", "anchor", "number", None)) > 20
    from lodeweave.operators import cards

    actions = Counter(r.action for r in cards.resegment_matched(stored, wanted).collect())
    assert set(actions) == {"add", "drop", "keep", "move", "protected"} and sum(actions.values()) == sum(map(len, got.values()))


def test_a_paper_s_log_is_never_held(spark):
    rows = [(1 + k % 2, k, None if k % 3 else f"r{k % 40}") for k in range(40_000)]
    df = spark.createDataFrame(rows, "paper_id long, op_id long, request string").repartition(4)

    def step(state, row):
        import gc

        state.append(row.op_id)
        if row.op_id < 39_998:
            return None
        return row.paper_id, len(state), sum(type(o).__name__ == "Row" and hasattr(o, "op_id") for o in gc.get_objects())

    out = sequences.streamed_groups(df, "paper_id", ["op_id"], lambda first: [], step, lambda state: [(-1, len(state), 0)], "paper_id long, n long, held long")
    got = sorted(map(tuple, out.collect()))
    assert [r[:2] for r in got] == [(-1, 20_000), (-1, 20_000), (1, 20_000), (2, 20_000)] and max(r[2] for r in got) < 10
    assert "streamed_groups" in layout_edits.receipts.__code__.co_names and "streamed_groups" in layout_edits.cards_after.__code__.co_names
