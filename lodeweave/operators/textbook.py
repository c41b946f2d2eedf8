"""Textbooks from layout blocks: worked examples and exercises among prose.

A textbook numbers its subsections like its exercises, so a numbered line counts
by what came before it: a stream of typed markers in reading order, in which
each kind of marker opens or closes practice areas, bundles of choices,
procedures and instructions. Each of these states is what the last marker that
sets it has set, a window over the paper's markers; no rule needs more.

``blocks`` are those of :mod:`.exam`.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exam import BEFORE_NEXT, HEADING, NUMERALS, PICTURES, column_lines, content, placed, slots
from .exam import headings as section_lines
from .sequences import ordered_groups
from .taxonomy import settled

# Words of textbooks. Labels of examples; titles of practice areas, of bundles of choices, of columns, of other parts;
# labels of solutions; titles after which numbered lines are steps or instructions; numbered parts of reports that are no questions.
EXAMPLES = "例题 例 Example Ex".split()
NO_EXAMPLE = "中 中的 中命题 的结果 的证明 的解法 的结论 参见 见例 见上例".split()
PRACTICES = "练习 习题 巩固练习 综合练习 复习题 复习参考题".split()
CHOICES = "选择题 单选择题 单项选择题 多项选择题".split()
COLUMNS = "做一做 随堂练习 议一议 想一想 读一读 问题解决 回顾与思考 综合与实践".split()
PARTS = "思考 探究 探究与发现 阅读与思考 信息技术应用 本章小结 小结 补集 部分中英文词汇索引 中英文词汇索引 索引 后记 附录".split()
SOLUTIONS = "分析 解析 解 解答 证明 解法 证法 Analysis Solution Proof".split()
STEPS = "步骤如下 过程可以概括为".split()
INSTRUCTIONS = "信息技术应用"
REPORT_FIELDS = "标题 提要或前言 正文 参考文献".split()
REPORT_STAGES = "收集数据 分析数据 建立模型 检验模型 求解问题 交流展示 研究结果 收获与体会".split()
CONTEXT_STAGE = r"观察实际情景\s*[，,]?\s*发现和提出问题\s*$"
# Words that make a line a question, and those that do so even among instructions.
ASKS = "已知 若 设 求 证明 求证 判断 计算 选择 填空 填表 画出 作出 写出 下列 如图 观察 说明 比较 解答 研究 借助 利用 回答 表示 举出 列出 指出 估计 设计 构建 完成 讨论 化简 解方程 为什么 为何".split()
ASKS_STRONGLY = "求 求证 证明 计算 判断 填空 填表 回答 为什么 为何".split()
# Longest title of a subsection, farthest block in which a lost number is looked for, scores of examples and exercises.
TITLE, REACH, EXAMPLE_SCORE, EXERCISE_SCORE = 24, 40, 5.0, 4.0


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_NUMBER = rf"([0-9]{{1,3}}|[{NUMERALS}]{{1,3}})"
_BLANK = r"[（(]\s*[）)]|_{2,}"
_EXAMPLE = rf"(?is)^\s*(?:\*{{1,2}}\s*)?{_any(EXAMPLES)}\.?\s*{_NUMBER}\s*[.．、:：]?\s*(.*)$"
_NUMBERED = r"(?s)^\s*[*※＊▲]?\s*([0-9]{1,3})\s*[.．、]\s*(.*)$"
_CHILD = r"(?s)^\s*[（(]\s*([0-9]{1,2})\s*[)）]\s*(.*)$"
_INSIDE = r"(?s)[？?。．.!！；;](?<![0-9]\.)\s*([0-9]{1,3})\s*[.．、]\s*(.+)$"
_PRACTICE = rf"^\s*(?:课后)?{_any(PRACTICES)}(?:\s*[0-9]+(?:\.[0-9]+)*)?\s*[：:]?\s*$"
_CHOICE = rf"^\s*[0-9]{{1,3}}\s*[.．、]\s*{_any(CHOICES)}\s*$"
_COLUMN = rf"^\s*{_any(COLUMNS)}\s*$"
_SOLUTION_LABEL = rf"{_any(SOLUTIONS[:4] + ['证明'])}\s*(?:[：:]|$)|{_any(['解法', '证法'])}(?:\s*[{NUMERALS}0-9]+)?\s*(?:[：:]|$)|{_any(SOLUTIONS[-3:])}\s*(?:[.:：]|$)"
_SOLUTION = rf"(?i)^\s*(?:{_SOLUTION_LABEL})"
_SOLUTION_INSIDE = rf"(?i)(?:\n|(?<=[。．.;；!?！？]))\s*(?:{_SOLUTION_LABEL})"
_SOLUTION_MATH = rf"\\(?:text|textbf|mbox|textrm)\s*\{{\s*(?:{_any(SOLUTIONS[:7] + ['答'])})(?:\s*[{NUMERALS}0-9]+)?\s*[：:]"
_DECIMAL = r"^\s*[0-9]+(?:\.[0-9]+){1,3}\s+\S"
_PART = rf"^\s*(?:第[{NUMERALS}0-9]+[章节篇单元]|{_any(PARTS)}|(?:思考|探究)\s*[{NUMERALS}0-9]+)\s*[：:]?\s*$"
_STEPS = rf"{_any(STEPS)}\s*[：:]?\s*$"
_TRANSITION = rf"^\s*下面在探究\s*[{NUMERALS}0-9]+\s*的基础上继续探究\s*[。．.]?\s*$"
_REPORT = rf"^(?:{_any(REPORT_FIELDS)}\s*[：:]|{CONTEXT_STAGE}|{_any(REPORT_STAGES)}\s*$|对此研究的评价(?:\s*[（(].*?[)）])?\s*$)"
_ASKS = rf"[？?]|{_BLANK}|{_any(ASKS)}"
_ASKS_STRONGLY = rf"[？?]|{_BLANK}|{_any(ASKS_STRONGLY)}"
_THINK = rf"^\s*思考(?:\s*[{NUMERALS}0-9]+)?\s*[：:]?\s*$"
_REFERS = rf"问题\s*{_NUMBER}\s*中"

_MARKER = "struct<kind:string,y:double,text:string,number:int,asks:boolean>"
_ORDER = ["page", "col", "y", "seq", "kind"]


def number_of(text: Column) -> Column:
    """The number that digits or numerals up to 99 write, null for 0 and others."""
    digit = lambda c: F.instr(F.lit(NUMERALS[:9]), c)
    tens, ones = F.split_part(text, F.lit("十"), F.lit(1)), F.split_part(text, F.lit("十"), F.lit(2))
    many = F.when(tens == "", 1).when(digit(tens) > 0, digit(tens)).otherwise(1) * 10 + F.when(ones == "", 0).otherwise(digit(ones))
    value = F.when(text.rlike("^[0-9]+$"), text.cast("int")).when(text.contains("十"), many).when(F.length(text) == 1, digit(text))
    return F.when(value > 0, value.cast("int"))


def _marker(kind: Column | str, y: Column, text: Column, number: Column | None = None, asks: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    number, asks = (F.lit(None) if c is None else c for c in (number, asks))
    return F.struct(kind.alias("kind"), y.cast("double").alias("y"), F.substring(text, 1, 160).alias("text"), number.cast("int").alias("number"), F.coalesce(asks.cast("boolean"), F.lit(False)).alias("asks"))


def _before(text: Column, pattern: str) -> Column:
    """Length of the text before the first match of a pattern, null without one."""
    return F.when(text.rlike(pattern), F.length(F.split(text, pattern, 2)[0]))


def markers(blocks: DataFrame) -> DataFrame:
    """(paper_id, seq, page, x, kind, y, text, number, asks) of every line that may start or end a card.

    A block can hold several: a solution's label or the next number inside a
    paragraph stands at a height in proportion to the text before it.
    """
    rows = content(blocks).where(~F.coalesce(F.col("type").isin(PICTURES), F.lit(False)))
    p = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\*\*", ""), r"^\s+|\s+$", ""))
    rows = rows.withColumn("p", p).where("p != '' and seq is not null")
    math = F.coalesce(F.col("type") == "equation", F.lit(False))
    by = Window.partitionBy("paper_id", "math").orderBy("seq")
    rows = rows.withColumn("math", math).repartition("paper_id").withColumns({"prev": F.lag("p").over(by), "next": F.lead("p").over(by)})  # all that follows stays in a paper's task
    math = F.col("math")
    # each pattern is searched once a block: what matched is kept in columns, what depends on a match is looked for only there
    digits = F.col("number_text")
    rows = rows.withColumns({"number_text": F.regexp_extract("p", _NUMBERED, 1), "example_text": F.regexp_extract("p", _EXAMPLE, 1), "child_text": F.regexp_extract("p", _CHILD, 1)})
    rows = rows.withColumn("inner_text", F.when(digits == "", F.regexp_extract("p", _INSIDE, 1)).otherwise(""))
    is_numbered, example, child, inner = digits != "", F.col("example_text") != "", F.col("child_text") != "", F.col("inner_text")
    panel = F.coalesce(F.col("prev").rlike(_THINK), F.lit(False)) | F.coalesce(F.col("next").rlike(_DECIMAL), F.lit(False))
    rows = rows.withColumns({
        "body": F.when(is_numbered, F.trim(F.regexp_extract("p", _NUMBERED, 2))),
        "inner_body": F.when(inner != "", F.trim(F.regexp_extract("p", _INSIDE, 2))),
        # a panel that asks again about a numbered problem
        "refers_text": F.when(~is_numbered & panel & F.col("p").rlike(r"[?？]") & F.col("p").rlike(_ASKS), F.regexp_extract("p", _REFERS, 1)),
        "solved_at": F.when(~math, _before(F.col("p"), _SOLUTION_INSIDE)),
        "formula_at": F.when(math, _before(F.col("p"), _SOLUTION_MATH)),
    })
    rows = rows.withColumns({"referred": F.when(F.col("refers_text") != "", number_of(F.col("refers_text"))), "example_number": F.when(example, number_of(F.col("example_text")))})
    p, size = F.col("p"), F.greatest(F.lit(1), F.length("p"))
    at = lambda before: F.col("y0") + (F.col("y1") - F.col("y0")) * before / size
    tail = lambda before: F.substr(p, before + 1)
    body, inner_body, referred, solved_at, example_number = (F.col(c) for c in ("body", "inner_body", "referred", "solved_at", "example_number"))
    again = referred.isNotNull()
    # the next number inside a paragraph
    inner_at = F.length("p") - F.length(F.regexp_extract("p", r"(?s)[？?。．.!！；;](?<![0-9]\.)\s*([0-9]{1,3}\s*[.．、]\s*.+)$", 1))
    embedded = (inner != "") & (inner.cast("int") > 0) & inner_body.rlike(_ASKS)
    ended = embedded & inner_body.rlike(r"[。．.？?]$") & ~inner_body.rlike(r"[（(]\s*[）)]")
    true_example = example_number.isNotNull() & ~F.ltrim(F.regexp_extract("p", _EXAMPLE, 2)).rlike(rf"^{_any(NO_EXAMPLE)}")
    steps = p.rlike(_STEPS)
    child_body = F.trim(F.regexp_extract("p", _CHILD, 2))
    line_number = digits.cast("int")
    y0, whole = F.col("y0"), F.col("text")
    own = (
        F.when(example, F.when(true_example, _marker("example_start", y0, whole, example_number, F.lit(True))).otherwise(_marker("example_reference", y0, whole, example_number)))
        .when(p.rlike(_PRACTICE), _marker("practice_header", y0, whole))
        .when(p.rlike(_CHOICE), _marker("choice_bundle_header", y0, whole))
        .when(p.rlike(_SOLUTION), _marker("analysis_solution", y0, whole))
        .when(p.rlike(HEADING) | p.rlike(_DECIMAL) | p.rlike(_PART) | steps | p.rlike(_TRANSITION), _marker(F.when(steps, "procedure_intro").otherwise("section_heading"), y0, whole))
        .when(child, F.when(child_body != "", _marker("parenthesized", y0, whole, F.col("child_text").cast("int"), child_body.rlike(_ASKS))))
        .when(is_numbered & (line_number > 0), _marker(F.when(body.rlike(_REPORT), "non_card_numbered").otherwise("numbered"), y0, whole, line_number, body.rlike(_ASKS)))
    )
    bottom = F.col("y1")
    found = F.array(
        F.when(again, _marker("context_question", y0, whole, referred, F.lit(True))),
        F.when(again, _marker("embedded_question_end", bottom + BEFORE_NEXT, F.lit(""))),
        F.when(embedded, _marker("numbered", at(inner_at), tail(inner_at), inner.cast("int"), F.lit(True))),
        F.when(ended, _marker("embedded_question_end", bottom, F.lit(""))),
        F.when(solved_at > 0, _marker("analysis_solution", at(solved_at), tail(solved_at))),
        own,
        F.when(p.rlike(_COLUMN), _marker("column_header", y0, whole)),
    )
    formula_at = F.col("formula_at")
    in_formula = F.array(F.when(formula_at.isNotNull(), _marker("analysis_solution", at(formula_at), tail(formula_at))))
    rows = rows.withColumn("found", F.array_compact(F.when(math, in_formula).otherwise(found)))
    return _with_context(rows).select("paper_id", "seq", "page", F.col("x0").alias("x"), F.explode("found").alias("m")).select("paper_id", "seq", "page", "x", "m.*")


def _with_context(rows: DataFrame) -> DataFrame:
    """``rows`` with the question below a numbered stage that only announces one among their markers: the next asking block of the page before any other marker."""
    announces = lambda m: (m["kind"] == "non_card_numbered") & F.trim(F.regexp_extract(m["text"], _NUMBERED, 2)).rlike(f"^{CONTEXT_STAGE}")
    own = F.array_max(F.transform(F.filter("found", announces), lambda m: F.struct(F.col("page").cast("int").alias("page"), m["number"].alias("number"))))
    by = Window.partitionBy("paper_id").orderBy("seq")
    peers, before = by.rangeBetween(Window.currentRow, Window.currentRow), by.rowsBetween(Window.unboundedPreceding, -1)
    # rows that hold a marker end the reach of the one before, other rows keep it
    seen = rows.withColumn("stage", own).withColumns({"marked": F.max(F.size("found") > 0).over(peers), "stage": F.max("stage").over(peers)})
    seen = seen.withColumn("over", F.last(F.when(~F.col("math") & F.col("marked"), F.struct("stage", F.col("seq").alias("at"))), True).over(before))
    below = ~F.col("math") & ~F.col("marked") & (F.col("over.stage.page") == F.col("page")) & F.col("p").rlike("[?？]") & F.col("p").rlike(_ASKS)
    asking = seen.withColumn("asking", F.coalesce(F.when(F.col("over.stage").isNotNull(), below), F.lit(False)))
    first = F.col("asking") & ~F.col("over.at").eqNullSafe(F.last(F.when(F.col("asking"), F.col("over.at")), True).over(before))
    pair = F.array(_marker("context_question", F.col("y0"), F.col("text"), F.col("over.stage.number"), F.lit(True)), _marker("embedded_question_end", F.col("y1") + BEFORE_NEXT, F.lit("")))
    return asking.withColumn("first", first).withColumn("found", F.when(F.col("first"), F.concat("found", pair)).otherwise(F.col("found")))


def _state(sets: Column) -> Column:
    """What the last marker before this one that says something has said; false before the first."""
    by = Window.partitionBy("paper_id").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(sets, True).over(by), F.lit(False))


def resolved(found: DataFrame) -> DataFrame:
    """Markers in reading order with ``role``: example, exercise, boundary or none, and the kind of the boundary."""
    kind = F.col("kind")
    # only numbered lines are judged by their words, once each
    body = F.col("body")
    found = found.withColumn("body", F.when(kind == "numbered", F.trim(F.regexp_extract(F.regexp_replace("text", r"\*\*", ""), _NUMBERED, 2))))
    found = found.withColumns({"strong": body.rlike(_ASKS_STRONGLY), "short": (body != "") & (F.length(body) <= TITLE) & ~F.col("asks") & ~body.rlike("[：:？?]$"), "bare": body == ""}).drop("body")
    strong, short, bare = F.col("strong"), F.col("short"), F.col("bare")
    numbered, off = kind == "numbered", F.lit(False)
    clears = kind.isin("example_start", "context_question")
    practice = F.when(kind == "practice_header", True).when(clears | kind.isin("choice_bundle_header", "procedure_intro", "section_heading", "non_card_numbered"), off)
    choices = F.when(kind == "choice_bundle_header", True).when(clears | numbered | kind.isin("practice_header", "column_header", "procedure_intro", "section_heading", "non_card_numbered"), off)
    procedure = F.when(kind == "procedure_intro", True).when(clears | kind.isin("practice_header", "column_header", "choice_bundle_header", "section_heading"), off)
    # instructions end with the first true question among them
    instructions = F.when(kind == "section_heading", F.col("text").contains(INSTRUCTIONS)).when(clears | kind.isin("practice_header", "column_header", "choice_bundle_header", "procedure_intro") | (numbered & strong & ~short & ~bare), off)
    at = found.withColumns({"practice": _state(practice), "choices": _state(choices), "procedure": _state(procedure), "instructions": _state(instructions)})
    title = F.col("procedure") | (F.col("instructions") & ~strong) | (~F.col("practice") & (short | bare))
    role = (
        F.when(kind == "example_start", "example")
        .when(kind == "context_question", "exercise")
        .when(numbered, F.when(title, "section_heading").otherwise("exercise"))
        .when(kind == "parenthesized", F.when(F.col("choices") & F.col("asks"), "exercise"))
        .when(kind.isin("choice_bundle_header", "procedure_intro", "non_card_numbered"), "section_heading")
        .when(kind.isin("practice_header", "section_heading", "analysis_solution", "embedded_question_end", "column_header"), kind)
    )
    return at.withColumn("role", role).select("paper_id", "seq", "page", "x", "col", "y", "kind", "text", "number", "role").where("role is not null")


def recovered(cards: DataFrame, blocks: DataFrame) -> DataFrame:
    """Exercises whose number was lost beside a table: between N and N + 2 of one column, one asking block after a table.

    The table is their anchor, so it belongs to them.
    """
    by = Window.partitionBy("paper_id").orderBy(*_ORDER)
    exercises = cards.where("role = 'exercise'")
    pairs = exercises.withColumn("then", F.lead(F.struct("seq", "page", "col", "number")).over(by)).where(f"then.page = page and then.col = col and then.number = number + 2 and then.seq - seq between 2 and {REACH}")
    pairs = pairs.select("paper_id", "page", "col", "number", F.col("seq").alias("from"), F.col("then.seq").alias("to"))
    p = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+", "")
    asking = ~F.coalesce(F.col("type") == "equation", F.lit(False)) & p.rlike("[?？]") & p.rlike(_ASKS) & ~p.rlike(_NUMBERED)
    lines = content(blocks).select("paper_id", "page", "seq", "x0", "y0", p.alias("text"), F.coalesce(F.col("type") == "table", F.lit(False)).alias("is_table"), (asking & ~F.coalesce(F.col("type").isin(PICTURES), F.lit(False))).alias("asking"))
    between = pairs.join(lines, ["paper_id", "page"]).where((F.col("seq") > F.col("from")) & (F.col("seq") < F.col("to")))
    one = between.groupBy("paper_id", "page", "col", "number", "from").agg(F.count_if("asking").alias("n"), F.min(F.when(F.col("asking"), F.struct("seq", "text"))).alias("q"), F.collect_list(F.when(F.col("is_table"), F.struct("seq", "x0", "y0"))).alias("tables"))
    anchor = F.array_max(F.filter("tables", lambda t: t["seq"] < F.col("q.seq")))
    return one.where("n = 1").withColumn("at", anchor).where("at is not null").select(
        "paper_id", F.col("at.seq").alias("seq"), "page", F.col("at.x0").alias("x"), "col", F.col("at.y0").alias("y"), F.lit("recovered").alias("kind"), F.substring("q.text", 1, 160).alias("text"), (F.col("number") + 1).cast("int").alias("number"), F.lit("exercise").alias("role")
    )


class Book(NamedTuple):
    """Cards with their place, boundaries, slots and lines between columns."""

    starts: DataFrame
    boundaries: DataFrame
    slots: DataFrame
    lines: DataFrame


def analyse(blocks: DataFrame) -> Book:
    """Examples and exercises of textbooks, and what ends them.

    Columns come from the lines that may be cards first, then from the cards.
    Null texts, boxes and places count for nothing; equal markers at one place
    stay each; a book without cards has boundaries only.
    """
    found = settled(markers(blocks))
    lines = column_lines(found.where("kind in ('example_start', 'numbered')"), blocks)
    cards = settled(resolved(placed(found, lines)))
    all_cards = cards.unionByName(recovered(cards, blocks))
    starts = all_cards.where("role in ('example', 'exercise') and number is not null")
    some = starts.select("paper_id").distinct()
    again = column_lines(starts, blocks)
    lines = settled(lines.join(some, "paper_id", "left_anti").unionByName(again))
    example = F.col("role") == "example"
    starts = placed(starts, lines).select("paper_id", "number", F.col("role").alias("source_kind"), "seq", "page", "col", "x", "y", F.when(example, EXAMPLE_SCORE).otherwise(EXERCISE_SCORE).alias("score"), F.lit(True).alias("at_start"), F.lit(0).alias("offset"), F.lit("read").alias("source"), "text")
    boundaries = placed(all_cards.where("role not in ('example', 'exercise')"), lines).select("paper_id", F.col("role").alias("kind"), "seq", "page", "col", "x", "y", "text")
    return Book(starts, boundaries, slots(blocks, lines), lines)


def stops(blocks: DataFrame, book: Book) -> DataFrame:
    """What ends a card besides the next one; a printed solution ends worked examples only."""
    own = placed(section_lines(blocks).where("kind = 'heading'"), book.lines).select("paper_id", "kind", "seq", "page", "col", "x", "y", "bottom", "text")
    by = Window.partitionBy("paper_id").orderBy("page", "col", "y", "seq").rowsBetween(Window.unboundedPreceding, -1)
    card = F.lit(None).cast("string")
    events = book.boundaries.withColumn("card", card).unionByName(book.starts.select("paper_id", F.lit("card").alias("kind"), "seq", "page", "col", "x", "y", "text", F.col("source_kind").alias("card")))
    ends = events.withColumn("in", F.last("card", True).over(by)).where("kind != 'card' and (kind != 'analysis_solution' or in = 'example')")
    ends = ends.select("paper_id", F.when(F.col("kind").isin("analysis_solution", "embedded_question_end"), "end").otherwise("heading").alias("kind"), "seq", "page", "col", "x", "y", F.lit(None).cast("double").alias("bottom"), "text")
    return own.unionByName(ends)


# Names of groups by the kind of their cards, the highest number that begins a numbering, the longest title of a chapter.
GROUPS, OPENING = {"example": "例题", "exercise": "习题"}, 3
_CHAPTER = rf"^\s*第\s*([0-9]{{1,3}}|[{NUMERALS}]{{1,3}})\s*([章篇])\s*(.{{0,24}}?)\s*$"


def _runs(cards: list) -> list[tuple]:
    """A book's cards with the run of numbers they belong to; another kind of card, or a number that falls back, opens one."""
    out, run, taken, top, kind = [], -1, set(), 0, None
    for place, c in enumerate(cards):
        back = c.number <= top and (c.number in taken or c.number <= OPENING)
        if c.source_kind != kind or back:
            run, taken, top, kind = run + 1, set(), 0, c.source_kind
        taken.add(c.number)
        top = max(top, c.number)
        out.append((c.paper_id, run, place, c.seq, c.page, c.number, c.source_kind))
    return out


def scopes(blocks: DataFrame, book: Book) -> DataFrame:
    """Numbering scopes of books: (paper_id, scope, source_kind, first_number, anchor_seq, start_page, first_page, last_page, seq_start, seq_end).

    A scope's pages reach to the next scope's start, the first one's and last
    one's to the ends of the book. Exercises begin at the practice title above
    them if it follows the scope before, so that a later pass over the scope
    still knows that they are exercises. The first scope has no start and the
    last no end. A book without cards has no scopes; cards without a page or
    number count for nothing.
    """
    cards = book.starts.where("page is not null and number is not null")
    order = ["page", "col", "y", "seq", "number"]
    runs = ordered_groups(cards.select("paper_id", "source_kind", *order), "paper_id", order, _runs, "paper_id long, scope int, place int, seq int, page int, number int, source_kind string")
    spot = F.struct("place", "seq", "page", "number", "source_kind")
    each = runs.groupBy("paper_id", "scope").agg(F.min(spot).alias("first"), F.max(spot).alias("last"))
    by = Window.partitionBy("paper_id").orderBy("scope")
    each = each.withColumns({"then": F.lead("first").over(by), "before": F.lag("last").over(by)})
    # the title right before each card among titles, headings and examples
    title = F.when(F.col("kind") == "card", F.when(F.col("source_kind") == "example", F.struct(F.lit("example").alias("kind"), "seq"))).otherwise(F.struct("kind", "seq"))
    marks = cards.select("paper_id", "page", "col", "y", "seq", F.lit("card").alias("kind"), "source_kind").unionByName(
        book.boundaries.where("kind in ('practice_header', 'section_heading')").select("paper_id", "page", "col", "y", "seq", "kind", F.lit(None).cast("string").alias("source_kind"))
    )
    above = Window.partitionBy("paper_id").orderBy("page", "col", "y", "seq", "kind").rowsBetween(Window.unboundedPreceding, -1)
    titled = marks.withColumn("title", F.last(title, True).over(above)).where("kind = 'card'").groupBy("paper_id", F.col("seq").alias("at")).agg(F.max("title").alias("title"))
    each = each.withColumn("at", F.col("first.seq")).join(titled, ["paper_id", "at"], "left")
    under = (F.col("first.source_kind") == "exercise") & (F.col("title.kind") == "practice_header") & (F.col("title.seq") > F.coalesce("before.seq", F.lit(-1)))
    start = F.when(F.col("scope") > 0, F.when(under, F.col("title.seq")).otherwise(F.col("first.seq")))
    ends = content(blocks).groupBy("paper_id").agg(F.min("page").alias("front"), F.max("page").alias("back"))
    pages = each.withColumn("start", start).join(ends, "paper_id", "left")
    upto = F.when(F.col("then").isNull(), F.col("back")).when(F.col("then.page") == F.col("last.page"), F.col("then.page")).otherwise(F.col("then.page") - 1)
    return pages.select(
        "paper_id", "scope", "first.source_kind", F.col("first.number").alias("first_number"), F.col("first.seq").alias("anchor_seq"), F.col("first.page").alias("start_page"),
        F.when(F.col("scope") == 0, F.col("front")).otherwise(F.col("first.page")).alias("first_page"), upto.alias("last_page"), F.col("start").alias("seq_start"), (F.lead("start").over(by) - 1).alias("seq_end"),
    )


def group_names(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(paper_id, scope, name) of the scopes below a chapter's title: chapter, its longest name in the book, kind; equal names are counted.

    The title of a scope is the last one at or before its anchor by seq; a
    chapter counts from 1 to 99 and digits and numerals are one chapter. Scopes
    above the first title have no name.
    """
    title = F.trim(F.coalesce("text", F.lit("")))
    number = number_of(F.regexp_extract(title, _CHAPTER, 1))
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract(title, _CHAPTER, 3), r"\s+", " "), r"^[ 　·—:：、-]+|[ 　·—:：、-]+$", "")
    chapters = blocks.where(F.col("seq").isNotNull() & title.rlike(_CHAPTER) & number.between(1, 99)).select("paper_id", "seq", F.struct(number.alias("number"), F.regexp_extract(title, _CHAPTER, 2).alias("unit")).alias("chapter"), name.alias("title"))
    longest = chapters.groupBy("paper_id", "chapter").agg(F.min(F.struct(-F.length("title"), "seq", "title")).alias("m")).select("paper_id", "chapter", "m.title")
    events = chapters.select("paper_id", "seq", F.lit(0).alias("turn"), "chapter").unionByName(found.select("paper_id", F.col("anchor_seq").alias("seq"), F.lit(1).alias("turn"), "scope", "source_kind"), allowMissingColumns=True)
    by = Window.partitionBy("paper_id").orderBy("seq", "turn").rowsBetween(Window.unboundedPreceding, 0)
    under = events.withColumn("chapter", F.last("chapter", True).over(by)).where("turn = 1 and chapter is not null").join(longest, ["paper_id", "chapter"])
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair]), F.col("source_kind"))
    label = F.concat(F.lit("第"), F.col("chapter.number").cast("string"), F.col("chapter.unit"), F.when(F.col("title") != "", F.concat(F.lit(" "), "title")).otherwise(""), F.lit(" · "), kind)
    same = Window.partitionBy("paper_id", "label")
    many = F.count("*").over(same) > 1
    nth = F.row_number().over(same.orderBy("scope"))
    return under.withColumn("label", label).select("paper_id", "scope", F.when(many, F.concat("label", F.lit(" "), nth.cast("string"))).otherwise(F.col("label")).alias("name"))
