"""Counter-examples for text functions, tables in text, chains and layouts."""

import itertools
import random
import re
import unicodedata

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeweave.functions import markup, text
from lodeweave.operators import cards, evaluation, segmentation, sequences, spatial
from lodeweave.plans import ORACLES, QUERIES
from lodeweave.streaming import jobs


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("$x^2$ cm²", "x^{2} cm^2", True),
        ("x²", "x2", False),
        ("\\angle ABC \\leqslant 90^\\circ.", "∠ABC ≤ 90°", True),
        ("a （3分） b", "ab", True),
        ("AB // CD", "AB∥CD", True),
        ("fill ____", "fill _", True),
        ("1，2", "1,2", True),
        ("12", "1,2", False),
    ],
)
def test_canon(a, b, same):
    assert (text.canon(a) == text.canon(b)) is same


@pytest.mark.parametrize(
    ("stem", "witness", "agrees"),
    [
        ("已知三角形面积为____.", "已知三角形面积为", True),
        ("the pair Q(4,56) is given", "the pair Q(45,6) is given", False),
        ("B.7 apples and pears", "B 7 apples and pears", True),
        ("seven apples and pears", "seven apples and pearsC.D.", True),
        ("seven apples and pears", "seven apples and pearsX.Y.", False),
        ("short", "short", False),
        ("the value of x,y here", "the value of xy here", False),
        ("the value of xy here", "the value of x,y here", False),
        ("", "whatever is here", False),
    ],
)
def test_witness(stem, witness, agrees):
    assert text.witness_agrees({"stem": stem}, witness) is agrees


def test_parallelogram_is_no_square():
    read = {"stem": "in ▱KLMN the sides are equal", "raw": "in ▱KLMN the sides are equal"}
    repaired = {**read, "raw": "in $\\square KLMN$ the sides are equal"}
    assert text.witness_agrees(read, "in □KLMN the sides are equal")
    assert not text.witness_agrees(repaired, "in ▱KLMN the sides are equal")


def test_objections_and_choice():
    spots = text.objections({"stem": "line segment AB equals 5 units"}, "line segment AC equals 5 units")
    assert [(s["reading"], s["witness"]) for s in spots] == [("B", "C")]
    assert text.objections({"stem": "abc"}, "abd") == []
    assert text.objections({"stem": "the value l0 is near"}, "the value 1O is near") == []  # look alike
    assert [s["at"] for s in text.objections({"stem": "one, two, four, five, six"}, "one two faur five six")] == [9]  # marks are no evidence
    a, b = {"stem": "points move along EF to the end"}, {"stem": "points move along FE to the end"}
    assert text.witness_choice(a, b, a["stem"]) == "a"
    assert text.witness_choice(a, b, b["stem"]) == "b"
    assert text.witness_choice(a, b, "nothing alike") is None
    assert text.witness_choice(a, a, a["stem"]) is None


def test_majority_needs_a_vote_for_each_spot():
    a, b = {"stem": "one cat sat here long"}, {"stem": "one hat sat hare long"}
    assert text.spotwise_majority(a, b, {"stem": "one cat sat hare long"})
    assert not text.spotwise_majority(a, b, {"stem": "one rat sat hare long"})


def test_small_text_functions():
    assert text.paired_quotes('"a" $"b"$ "c"') == '“a” $"b"$ “c”'
    assert text.match_tags("linear functions and sets", ["function", "linear functions", "sets"]) == ["linear functions", "sets"]
    assert text.match_tags("set of sets", ["sets", "set"]) == ["set", "sets"]
    assert text.match_tags("sets and a set", ["sets", "set"]) == ["sets", "set"]  # at its second place
    assert text.name_key("Ｓｅｔ  s") == "sets"


def test_trimmed_answers(spark):
    cases = {"ab $x+y$ c": "ab ", "$x$ ab $y": "$x$ ab", "$$$": "$$", "": "", None: "", "abcdefgh": "abcdef", "漢字漢字漢字漢": "漢字漢字漢字"}
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    assert [r.a for r in df.select("k", text.trim_answer(F.col("t"), 6).alias("a")).orderBy("k").collect()] == list(cases.values())


def test_gaps_of_witnesses():
    """What a witness may lack or add, case by case."""
    long = "已知三角形的面积为六"
    may = [(f"{long}，", long), (f"{long}____。", long), (f"{long}()", long), ("甲,乙丙丁戊己庚", "甲乙丙丁戊己庚"), ("abcdefg;(2)xyz", "abcdefg(2)xyz"), ("abcdefg.(iv)xyz", "abcdefg(iv)xyz"), ("甲乙丙丁戊己 A.2x", "甲乙丙丁戊己 A2x"), ("abcdefgh", "abcdefghA.B."), ("abcdefgh A.7", "abcdefgh B.A.7")]
    not_ = [("abcde,fgh", "abcdefgh"), ("abcdefg,(123)xy", "abcdefg(123)xy"), ("abcdefg_(2)xyz", "abcdefg(2)xyz"), ("abcdefgXA.2", "abcdefgXA2"), ("abcdefgh", "abcdefghF."), ("abcd.ef.gh,,,x", "abcd.ef.ghx"), (long, f"{long}七")]
    for reading, witness in may:
        assert text.witness_agrees({"stem": reading}, witness), (reading, witness)
    for reading, witness in not_:
        assert not text.witness_agrees({"stem": reading}, witness), (reading, witness)


def test_squares_of_corners():
    assert all(map(text._square_of_corners, ["□ABCD", "in $\\square$ A B", "{\\Box}KLM", "x ◻ PQ"]))
    assert not any(map(text._square_of_corners, ["□ is", "□A", "\\squareroot AB", "▱ABCD", "", "□ 3AB"]))


def plain_canon(value):
    """A text as it is compared, read character by character."""
    folded = unicodedata.normalize("NFKC", "".join(f"^{'⁰¹²³⁴⁵⁶⁷⁸⁹'.index(c)}" if c in "⁰¹²³⁴⁵⁶⁷⁸⁹" else c for c in value or ""))
    out, i = [], 0
    while i < len(folded):
        rest = folded[i:]
        points = re.match(r"\(\s*[0-9]{1,2}\s*(分|points|point)\s*\)", rest)
        blank = re.match(r"__+|\\underline\{(\\quad(?![A-Za-z])|\\qquad(?![A-Za-z])|[~\s])*\}", rest)
        room = re.match(r"\\(hspace|vspace)\*?\{[^{}]*\}", rest)
        name = re.match(r"\\([A-Za-z]+)", rest)
        if points or room:
            i += (points or room).end()
        elif blank:
            out.append("_")
            i += blank.end()
        elif name:
            out.append("" if name[1] in text.SPACING else text.SYMBOLS.get(name[1], name[1]).strip("{}"))
            i += name.end()
        elif rest[0] == "\\" and len(rest) > 1:
            out.append("" if rest[1] in ",;:! {}" else rest[1])
            i += 2
        else:
            out.append(rest[0])
            i += 1
    marks = {chr(k): v for k, v in text.MARKS.items()}
    flat = "".join("" if c in "$\\{}" or c.isspace() else marks.get(c, c) for c in "".join(out))
    flat = "".join(flat.split())
    for old, new in (("//", "∥"), ("^°", "°"), ("[]", "()")):
        flat = flat.replace(old, new)
    return flat.rstrip(".,;:")


def test_canon_of_all_texts(spark, sf):
    from lodeweave.plans import QUERIES

    odd = ["x² （3分） \\underline{\\quad ~}__ \\hspace{2em}", "\\leqslant{}\\alpha\\, \\{a\\}", "ＡＢ，。；：【】", "AB//CD ^\\circ []", "\\left( \\dfrac{1}{2} \\right).", "(12 points) (123 points)", "\\", "\\quadx \\square", None, "", "  ~ \n"]
    for a in odd:
        assert text.canon(a) == plain_canon(a), a
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = QUERIES["scl1_canonical"](spark, sf).collect()
    assert len(found) == len(docs)
    for r in found:
        assert r.key == plain_canon((docs[r.doc_id] or "") + " $\\angle A \\le {90}^\\circ$ (5 points) cm².;")
    same = {r.doc_id: r.same for r in QUERIES["scl2_same_reading"](spark, sf).collect()}
    assert len(same) == len(docs) and 0 < sum(same.values()) < len(same)
    for i, t in docs.items():
        t = t or ""
        other = t if i % 3 == 0 else t[:20] + "x" + t[21:] if i % 3 == 1 else t + "."
        assert same[i] == (plain_canon(t) == plain_canon(other)), i


def test_tables():
    assert markup.pipe_tables("|x|=2") == []
    assert markup.cells(r"| a \| b | $|x|$ |") == ["a | b", "$|x|$"]
    assert markup.html_rows("<table><tr><td rowspan='99' colspan=2>a&amp;b<br>c</td></tr></table>")[0][0] == {"text": "a&b c", "rowspan": 60, "colspan": 2, "header": False}
    assert markup.to_text("<table><tr><th>a</th></tr><tr><td>1</td><td>2</td></tr></table>") == "| a |  |\n|---|---|\n| 1 | 2 |"
    assert markup.without_tables("x\n| a | b |\n| c | d |\ny") == "x\n\ny"
    assert markup.to_text("") == ""


def test_best_chain():
    assert sequences.best_chain([], []) == []
    assert sequences.best_chain([1, 2, 9, 3], [3, 3, 3, 3]) == [0, 1, 3]
    assert sequences.best_chain([5, 1, 2], [1, 3, 3]) == [1, 2]


def test_best_chain_brute_force():
    """The sum of the chain is the best of all rising subsequences."""
    rng = random.Random(8)

    def worth(chain, numbers, scores):
        total = sum(scores[k] for k in chain) - min(sequences.START_MOST, sequences.START_COST * max(0, numbers[chain[0]] - 1))
        return total - sequences.GAP_COST * sum(numbers[b] - numbers[a] - 1 for a, b in zip(chain, chain[1:]))

    for _ in range(120):
        n = rng.randint(1, 9)
        numbers, scores = [rng.randint(0, 12) for _ in range(n)], [rng.choice((0.2, 1, 2.5, 4)) for _ in range(n)]
        chains = [c for k in range(1, n + 1) for c in itertools.combinations(range(n), k) if all(numbers[a] < numbers[b] for a, b in zip(c, c[1:]))]
        found = sequences.best_chain(numbers, scores)
        assert all(numbers[a] < numbers[b] for a, b in zip(found, found[1:])) and found == sorted(found)
        assert worth(found, numbers, scores) == pytest.approx(max(worth(c, numbers, scores) for c in chains))


def test_gap_repairs(spark):
    """Last digits where they are the only ones; unnumbered starts where as many are left as numbers and order holds."""
    frame = lambda rows: spark.createDataFrame(rows, "paper_id long, seq int, number int")
    chain = frame([(1, 0, 11), (1, 5, 14), (2, 0, 1), (2, 4, 4), (3, 0, 22), (3, 9, 25), (4, 0, 1), (4, 3, 3)])
    shown = chain.union(frame([(1, 2, 2), (3, 2, 3), (3, 3, 3), (4, 7, 2)]))
    none = spark.createDataFrame([(1, 4), (2, 1), (2, 2), (3, 5), (4, 9)], "paper_id long, seq int")
    got = sorted((r.paper_id, r.seq, r.number, r.by) for r in sequences.gap_repairs(chain, shown, none).collect())
    assert got == [(1, 2, 12, "digits"), (1, 4, 13, "order"), (2, 1, 2, "order"), (2, 2, 3, "order")]
    late = frame([(5, 0, 20), (5, 6, 23), (5, 4, 1)])  # the digits stand after the unnumbered start, which then breaks the order
    got = sequences.gap_repairs(late.where("number > 9"), late, spark.createDataFrame([(5, 5)], "paper_id long, seq int")).collect()
    assert sorted((r.seq, r.number) for r in got) == [(4, 21), (5, 22)]
    got = sequences.gap_repairs(late.where("number > 9"), late.withColumn("number", F.when(F.col("number") == 1, 2).otherwise(F.col("number"))), spark.createDataFrame([(5, 5)], "paper_id long, seq int")).collect()
    assert [(r.seq, r.number) for r in got] == [(4, 22)]


def test_matching_is_maximal():
    assert evaluation.most_matches({1: [1, 2], 2: [1], 3: [2]}) == 2
    assert evaluation.iou((0, 0, 2, 2), (1, 1, 3, 3)) == pytest.approx(1 / 7)
    assert evaluation.iou((0, 0, 1, 1), (2, 2, 3, 3)) == 0


def test_segment_two_columns(spark):
    rows = [(1, 0, 0, 50.0, 100.0, 450.0, 140.0, "text", "1. What is it"), (1, 1, 0, 550.0, 100.0, 950.0, 140.0, "text", "3. Find x"), (1, 2, 0, 50.0, 300.0, 450.0, 340.0, "text", "2. Which one"), (1, 3, 0, 50.0, 400.0, 450.0, 440.0, "text", "more of it")]
    blocks = spark.createDataFrame(rows, "paper_id long, seq int, page int, x0 double, y0 double, x1 double, y1 double, type string, text string")
    found = segmentation.segment(blocks).orderBy("number").collect()
    assert [(r.number, r.first_seq) for r in found] == [(1, 0), (2, 2), (3, 1)]
    assert found[1].text == "2. Which one\nmore of it"
    assert [tuple(b) for b in found[1].regions] == [(0, 30.0, 291.0, 535.0, 444.0)]


def test_throttle():
    assert jobs.throttle(["throttled", "throttled", *["ok"] * 5], 4) == [3, 3, 3, 3, 3, 3, 4]


def test_throttled_pools(spark):
    rng = random.Random(1)
    pools = {p: [rng.choice(("ok", "ok", "ok", "throttled")) for _ in range(60)] for p in range(5)}
    rows = [(p, k, o) for p, outcomes in pools.items() for k, o in enumerate(outcomes)]
    got = jobs.throttled(spark.createDataFrame(rows, "pool long, step long, outcome string").repartition(6), 4).collect()
    levels = {(r.pool, r.step): r.level for r in got}
    assert len(got) == 300 and all([levels[p, k] for k in range(60)] == jobs.throttle(o, 4) for p, o in pools.items())


def test_columns_of_a_page(spark):
    box = lambda page, boxes: [(1, page, float(a), float(b)) for a, b in boxes]
    left, right, over = [(40, 460)] * 8, [(540, 960)] * 8, [(300, 700)]
    rows = box(0, left + right + over * 2) + box(1, left + right + over * 4) + box(2, left) + box(3, [(40, 460), (540, 960)]) + box(4, [(40, 505), (540, 960), (40, 460)])
    got = {r.page: r.columns for r in spatial.column_split(spark.createDataFrame(rows, "paper_id long, page int, x0 double, x1 double")).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 1, 4: 2}


def test_ordered_groups(spark):
    df = spark.createDataFrame([(k % 5, k, k % 7) for k in range(200)], "g long, o long, v long").repartition(7)
    out = sequences.ordered_groups(df, "g", ["o"], lambda rows: [(rows[0].g, len(rows), [r.o for r in rows] == sorted(r.o for r in rows))], "g long, n long, sorted boolean").collect()
    assert sorted((r.g, r.n, r.sorted) for r in out) == [(g, 40, True) for g in range(5)]


def test_section_label_of_a_bare_number(spark):
    rows = spark.createDataFrame([("56.187.231.17",), ("56.187.231.175 Kei",), ("5.5.2 a short title",), ("5.3 a title, cut off",), ("5.33: a title cut",)], "s string")
    assert [r[0] for r in rows.select(text.section_label(F.col("s"))).collect()] == ["56.187.231.17", "56.187.231.175 Kei", "5.5.2 a short title", "", ""]


def test_section_labels_equal_their_sql_on_odd_texts(spark, tmp_path):
    begins = [None, "", "144.126.223.8 Kei", "144.126.223.85", "290281.9972.8 9", "1.1.1.1.1.1.1.1.1", "a\rb", "a, b", "简单，变换", "标题：一", "\u3000a\u00a0 b\u2003", "\u2028a b", "a\u0085", "\tb . c", "12.5: d", "\n\r\n.", "5.5.5.5.5.55.", "é 👍🏽 1.25.25.25.2"]
    rows = [(k, begins[k // 48]) for k in range(48 * len(begins))]  # each at every length of a cut
    rows += [(-k, begins[k]) for k in range(1, len(begins))] + [(None, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = [tuple(r) for r in QUERIES["scl25_section_label"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.execute(ORACLES["scl25_section_label"]).fetchall(), key=str)
    assert ("144.126.223.8" in dict(got).values()) and ("简单，变换" in dict(got).values())


def test_cuts_snap_to_the_nearest_of_many_gaps(spark):
    random.seed(5)
    gaps = [(k % 2, a, a + random.choice([0, 4, 8])) for k in range(300) for a in [random.randrange(400)]] + [(0, None, 5), (None, 1, 5), (0, 6, 12)]
    cuts = [(k % 3, k, random.choice([random.randrange(900) / 2, float(random.randrange(450))])) for k in range(400)] + [(0, 400, None), (0, 401, 7.0), (0, 401, 7.0), (None, 402, 3.0), (0, None, 9.0)]
    got = cards.snapped_cuts(spark.createDataFrame(cuts, "page_id long, cut_id long, y double"), spark.createDataFrame(gaps, "page_id long, from long, to long"))
    middles = {p: [(a + b) / 2 for q, a, b in gaps if q == p and a is not None] for p in (0, 1)}

    def plain(page, c, y):
        near = [(abs(m - y), m) for m in middles.get(page, []) if abs(m - y) <= 15] if y is not None and c is not None else []
        return min(near)[1] if near else y

    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(p, c, plain(p, c, y)) for p, c, y in cuts], key=key)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # pairs of a page's cuts and gaps would grow with their product


def test_few_texts_of_a_batch_are_objects_at_once(spark):
    def alive(x, _seen=[]):  # noqa: B006 - counts the texts of which the batch still holds an object
        import sys

        _seen.append(x)
        held = sum(sys.getrefcount(s) > 3 for s in _seen)
        return str(held)

    batch = pa.array([f"text {k}" for k in range(1000)])
    assert max(int(x) for x in text._sliced(alive, pa.string(), batch).to_pylist()) <= 2 * text._SLICE
    assert text._sliced(lambda a, b: f"{a}{b}", pa.string(), batch, pa.array([None] * 1000, pa.string()))[999].as_py() == "text 999None"
    assert len(text._sliced(str, pa.string(), pa.array([], pa.string()))) == 0
    rows = spark.range(0, 300, 1, 1).select("id", text.text_column(text.search_key, F.concat(F.lit("A $ "), F.col("id").cast("string"))).alias("key"))
    assert [r.key for r in rows.orderBy("id").collect()] == [f"a{k}" for k in range(300)]
