"""Exam papers from layout blocks: question starts, column lines, slots, regions.

``blocks(paper_id, seq, page, x0, y0, x1, y1, type, text)`` in thousandths of a
page. Columns of a page are found from the margins at which questions begin, for
a page with a single margin from those of its paper, and each line between two
columns is checked on each page. Reading order is page, column, height.

A paper is a bounded group. All is windows and joins keyed by paper or page but
the choice of the best chain of numbers, which streams one paper at a time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import best_chain, ordered_groups
from .taxonomy import settled

# Kinds of blocks that hold no questions, and pictures.
FURNITURE = ["header", "footer", "page_number", "page_footnote", "aside_text"]
PICTURES = ["image", "table", "chart"]
# Fixed values, in thousandths of a page: least distance of two margins, line before a margin, where lines may be, tolerance at a line.
MARGIN_GAP, BEFORE_MARGIN, LINE_FROM, LINE_TO, TOLERANCE = 120.0, 15.0, 250.0, 750.0, 8.0
# Space above a start, more of it inside a block and for a place that a model named, space before the next, least height.
PAD, PAD_INSIDE, PAD_LOCATED, BEFORE_NEXT, SLIVER = 9.0, 12.0, 20.0, 2.0, 8.0
# Words of notices and of what they ask for.
NOTICES = "注意事项 考生须知 答题须知 考试须知 答卷须知".split()
NOTICE_WORDS = "答题前 答卷前 答题卡 答题纸 准考证 考生号 考籍号 条形码 考试结束 签字笔 2B铅笔 试题卷 试卷上 本试卷 考试时间 草稿纸 选涂 涂黑 作答无效 答题无效 交回".split()
# Words that open a question whose number lost its dot.
OPENERS = "如图 如下 已知 若 设 在 计算 化简 求 解 下列 某 用 把 将 当 对于 阅读 观察 先 有 甲 抛物线 函数 直线 点 △ ▱ ⊙".split()

# Words with which a question opens, sources of questions, what is no question, what asks.
STEMS = "已知 若 设 下列 如图 根据 阅读 观察 判断 计算 证明 求 关于 对于".split()
SOURCES = "高考 中考 联考 期中 期末 月考 模拟".split()
NO_QUESTION = "注意事项 答卷前 考试时间 满分 姓名 班级 考号 密封线 请将答案 选择题 填空题 解答题 参考公式".split()
ASKING = "求 证明 计算 判断 选择 填空".split()
# Blocks that support a stem, score that repairs, score that is told.
SUPPORT, REPAIRS, TOLD = 10, 7, 4

NUMERALS = "一二三四五六七八九十"
_HAN = "\\u4e00-\\u9fff"
_LABEL = r"[0-9]{1,2}\s*[.．、]"
_QUESTION_LIKE = rf"^[\s$]*(?:[{_HAN}（(【]|(?:What|Which|How|Find|Show|Let|Given|If)\b)"
_POINTS = r"^\s*[（(]\s*[0-9]+\s*(?:分|points?)"
_UNNUMBERED = r"^\s*[（(]\s*(?:(?:本题)?满分\s*[0-9]{1,2}\s*分|[0-9]{1,2} points)\s*[)）]"
_BARE = rf"^[\s$]*([0-9]{{1,2}})(?:\s+[{_HAN}]|(?:{'|'.join(OPENERS)}))"
HEADING = rf"^\s*(?:(?:[{NUMERALS}]{{1,3}}|[ⅠⅡⅢⅣ]+)\s*[、.．]|第[{NUMERALS}]+部分)"
_SUBHEADING = r"^\s*(?:[(（]\s*[一二三]\s*[)）]\s*(?:必考|选考)题|[\[【(（]?\s*选修\s*[0-9]+\s*[-－—–]\s*[0-9]+\s*[:：])"
_KEY = ["page", "col", "y"]


def plain(text: str | Column = "text") -> Column:
    """Text without inline tags that a reader put around parts of a line; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"(?i)</?(?:sub|sup|span|b|i|u|em|strong)\b[^>]*>", "")


def content(blocks: DataFrame) -> DataFrame:
    return blocks.where(~F.coalesce(F.col("type").isin(FURNITURE), F.lit(False)) & F.col("x0").isNotNull() & F.col("y0").isNotNull())


def textual(blocks: DataFrame) -> DataFrame:
    return content(blocks).where(~F.coalesce(F.col("type").isin(PICTURES), F.lit(False)) & (F.trim(plain()) != ""))


def starts(blocks: DataFrame) -> DataFrame:
    """Where a question may start: (paper_id, seq, page, x, y, number, score, at_start, offset, source).

    ``read`` starts have a number with a dot: at the start of a block, or inside
    it where the text goes on like a question, ``offset`` characters on; there the
    height is that of the line, or in proportion to the text before. Number 0 is a number that lost
    its first digit and only fills gaps. ``bare`` ones lost their dot and
    ``unnumbered`` ones the number; both only fill gaps too.
    """
    rows = textual(blocks).withColumn("text", plain())
    parts = rows.withColumn("parts", F.split("text", rf"(?<![0-9A-Za-z.．\\^_{{])(?={_LABEL}{{1,2}}(?![0-9]))"))
    cut = parts.select("*", F.posexplode("parts").alias("k", "part"))
    number = F.regexp_extract("part", r"^([0-9]{1,2})\s*[.．、]{1,2}(?![0-9])", 1)
    before = F.array_join(F.slice("parts", F.lit(1), F.col("k")), "")
    cut = cut.where(number != "").select(*blocks.columns, number.cast("int").alias("number"), before.alias("before"), F.regexp_replace("part", r"^[0-9]{1,2}\s*[.．、]{1,2}", "").alias("after"))
    at_start, like = F.col("before").rlike(r"^[ $　\s]*$"), F.col("after").rlike(_QUESTION_LIKE)
    height, lines = F.col("y1") - F.col("y0"), F.size(F.split("text", "\n"))
    line = F.least(F.lit(24.0), F.greatest(F.lit(14.0), height / lines))
    at_line = F.col("before").rlike(r"\n[ $　]*$")
    y = (
        F.when(at_start, F.col("y0"))
        .when(at_line, F.least(F.col("y1") - line, F.col("y0") + (F.size(F.split("before", "\n")) - 1) * line))
        .when(height > 40, F.greatest(F.col("y0"), F.col("y0") + height * F.length("before") / F.length("text") - 6))
        .otherwise(F.col("y0"))
    )
    score = 1.0 + F.when(at_start, 2.0).otherwise(0.0) + F.when(like, 1.0).otherwise(0.0) + F.when(F.col("after").rlike(_POINTS), 1.5).otherwise(0.0) - F.when(F.col("type") == "equation", 1.5).otherwise(0.0)
    read = cut.where(F.when(F.col("number") == 0, at_start).otherwise(at_start | like)).select(
        "paper_id", "seq", "page", F.col("x0").alias("x"), y.alias("y"), "number", F.when(F.col("number") == 0, 0.2).otherwise(score).alias("score"), at_start.alias("at_start"), F.length("before").alias("offset"), F.lit("read").alias("source")
    )
    bare = F.regexp_extract("text", _BARE, 1).cast("int")
    lost = rows.select("paper_id", "seq", "page", F.col("x0").alias("x"), F.col("y0").alias("y"), F.when(F.col("text").rlike(_UNNUMBERED), F.lit(0)).when(F.col("text").rlike(_BARE), F.when(bare > 0, bare)).alias("number"), F.lit(0.5).alias("score"), F.lit(True).alias("at_start"), F.lit(0).alias("offset"))
    return read.unionByName(lost.where("number is not null").withColumn("source", F.when(F.col("number") == 0, "unnumbered").otherwise("bare")))


def headings(blocks: DataFrame) -> DataFrame:
    """(paper_id, seq, page, x, y, bottom, kind, text) of section lines, and of lines that only end a question."""
    kind = F.when(F.col("text").rlike(HEADING), "heading").when(F.col("text").rlike(_SUBHEADING), "subheading")
    return textual(blocks).select("paper_id", "seq", "page", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("y1").alias("bottom"), kind.alias("kind"), F.substring(F.trim("text"), 1, 80).alias("text")).where("kind is not null")


def without_notices(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Starts but the numbered items of a notice: the first ones after its title, as long as they speak of what notices ask for."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?<=2B)\s+(?=铅笔)", "")
    title = text.rlike(rf"^\s*(?:{'|'.join(NOTICES)})")
    said = blocks.select("paper_id", "seq", title.alias("title"), (title | text.rlike("|".join(NOTICE_WORDS))).alias("asks"), "page", "y0")
    first = said.where("title and y0 is not null").groupBy("paper_id").agg(F.min(F.struct("page", F.col("y0").alias("y"))).alias("notice"))
    by = Window.partitionBy("paper_id").orderBy("page", "y", "seq", "number")
    marked = found.where("source = 'read'").join(first, "paper_id").where(F.struct("page", "y") >= F.col("notice")).join(said.groupBy("paper_id", "seq").agg(F.bool_or("asks").alias("asks")), ["paper_id", "seq"], "left")
    other = F.sum(F.when(F.coalesce("asks", F.lit(False)), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    gone = marked.withColumn("other", other).where("other = 0").select("paper_id", "seq", "page", "y", "number")
    reads = found.where("source = 'read'").groupBy("paper_id").count()
    some = gone.groupBy("paper_id").agg(F.count("*").alias("n")).join(reads, "paper_id").where("n < count").select("paper_id")
    gone = gone.join(some, "paper_id", "left_semi").withColumn("source", F.lit("read"))
    return found.join(gone, ["paper_id", "seq", "page", "y", "number", "source"], "left_anti")


def column_lines(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper_id, page, lines): places of the lines between columns of pages that have some.

    A margin begins where starts lie further right than ``MARGIN_GAP`` from the
    one before. A page with one margin tries its paper's. A line must lie in the
    middle, have content on both sides and be crossed by little.
    """
    margins = found.select("paper_id", "page", "x").distinct()
    line = F.greatest(F.lit(0.0), F.col("x") - BEFORE_MARGIN).alias("line")
    later = lambda *key: margins.withColumn("last", F.lag("x").over(Window.partitionBy(*key).orderBy("x"))).where(F.col("x") - F.col("last") > MARGIN_GAP)
    own = later("paper_id", "page").select("paper_id", "page", line).distinct()
    shared = later("paper_id").select("paper_id", line).distinct()
    pages = blocks.select("paper_id", "page").distinct()
    tried = own.unionByName(pages.join(own, ["paper_id", "page"], "left_anti").join(shared, "paper_id")).where(F.col("line").between(LINE_FROM, LINE_TO))
    left = (F.col("x0") + F.col("x1")) / 2 < F.col("line")
    crossed = (F.col("x0") < F.col("line") - TOLERANCE) & (F.col("x1") > F.col("line") + TOLERANCE)
    sides = content(blocks).select("paper_id", "page", "x0", "x1").join(tried, ["paper_id", "page"]).groupBy("paper_id", "page", "line").agg(F.count("*").alias("n"), F.count_if(left).alias("left"), F.count_if(crossed).alias("crossing"))
    kept = sides.where("n >= 3 and left >= 1 and n - left >= 1").where(F.col("crossing") <= F.greatest(F.lit(2.0), 0.15 * F.col("n")))
    return kept.groupBy("paper_id", "page").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _lined(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` with ``lines`` of their page. The join is by paper, like all that follows it, so rows are dealt out once."""
    pages = lines.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "lines"))).alias("_pages"))
    return rows.join(pages, "paper_id", "left").withColumn("lines", F.try_element_at("_pages", "page")).drop("_pages")


def _column(x: Column) -> Column:
    return F.coalesce(F.size(F.filter("lines", lambda line: line <= x)), F.lit(0))


def placed(rows: DataFrame, lines: DataFrame, x: Column | None = None) -> DataFrame:
    """``rows`` with ``col``, the column of their left edge (or of ``x``)."""
    x = F.col("x") + 1 if x is None else x
    return _lined(rows.drop("col"), lines).withColumn("col", _column(x)).drop("lines")


def slots(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """(paper_id, slot, page, col, x0, x1, top, bottom): columns with content in reading order.

    Columns are cut at the lines, not at the text, so that what was not read stays inside.
    """
    cx = (F.col("x0") + F.col("x1")) / 2
    inside = _lined(content(blocks).select("paper_id", "page", "x0", "y0", "x1", "y1"), lines).withColumn("col", _column(cx))
    inside = inside.groupBy("paper_id", "page", "col", "lines").agg(F.min("x0").alias("from"), F.max("x1").alias("to"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    edge = lambda k: F.get("lines", k)
    out = inside.withColumn("n", F.coalesce(F.size("lines"), F.lit(0)))
    by = Window.partitionBy("paper_id").orderBy("page", "col")
    return out.select(
        "paper_id",
        (F.row_number().over(by) - 1).alias("slot"),
        "page",
        "col",
        F.when(F.col("col") > 0, edge(F.col("col") - 1)).otherwise(F.greatest(F.lit(0.0), F.col("from") - 20)).alias("x0"),
        F.when(F.col("col") < F.col("n"), edge(F.col("col"))).otherwise(F.least(F.lit(1000.0), F.col("to") + 20)).alias("x1"),
        F.greatest(F.lit(0.0), F.col("y0") - 4).alias("top"),
        F.least(F.lit(1000.0), F.col("y1") + 4).alias("bottom"),
    )


def _chained(rows: list, fill: bool) -> list[tuple]:
    """One paper's starts on the best chain; with ``fill`` also those that fill its gaps."""
    read = [r for r in rows if r.source == "read" and r.number > 0]
    chain = [read[k] for k in best_chain([r.number for r in read], [r.score for r in read])]
    out = [(r, r.number, r.source) for r in chain]
    key = lambda r: (r.page, r.col, r.y)
    for a, b in zip(chain, chain[1:]) if fill else ():
        wanted = list(range(a.number + 1, b.number))
        between = [r for r in rows if key(a) < key(r) < key(b)] if wanted else []
        given: dict[int, object] = {}
        # a number that shows its last digits only, if nothing else does
        cut = [r for r in between if r.source == "read" and r.at_start]
        for n in wanted:
            ends = [r for r in cut if r.number != n and str(n).endswith(str(r.number))]
            if len(ends) == 1:
                given[n] = ends[0]
                cut = [r for r in cut if key(r) > key(ends[0])]
        # a number without its dot
        used = {r.seq for r in given.values()}
        for n in wanted:
            same = [r for r in between if r.source == "bare" and r.number == n and r.seq not in used]
            if n not in given and len(same) == 1:
                given[n] = same[0]
                used.add(same[0].seq)
        # as many starts without a number as numbers are left, if all then rise
        left, loose = [n for n in wanted if n not in given], [r for r in between if r.source == "unnumbered" and r.seq not in used]
        if left and len(left) == len(loose):
            both = given | dict(zip(left, loose))
            ordered = sorted(both, key=lambda n: key(both[n]))
            if all(m < n for m, n in zip(ordered, ordered[1:])):
                given = both
        out += [(r, n, "repaired") for n, r in given.items()]
    return [(r.paper_id, n, r.seq, r.page, r.col, r.x, r.y, r.score, r.at_start, r.offset, source) for r, n, source in sorted(out, key=lambda x: key(x[0]))]


def numbered(found: DataFrame, fill: bool) -> DataFrame:
    """The starts on each paper's best chain of rising numbers."""
    schema = "paper_id long, number int, seq int, page int, col int, x double, y double, score double, at_start boolean, offset int, source string"
    return ordered_groups(found, "paper_id", ["page", "col", "y", "seq", "number"], lambda rows: _chained(rows, fill), schema)


class Layout(NamedTuple):
    """What an analysis gives: question starts, the pages' slots, lines that end questions, and lines between columns."""

    starts: DataFrame
    slots: DataFrame
    headings: DataFrame
    lines: DataFrame


def analyse(blocks: DataFrame) -> Layout:
    """Starts, slots and headings of exam papers.

    Columns are first inferred from the sure starts, then, if three or more
    starts make a chain, anew from these. Numbers before the first section are
    instructions if a first question follows it. Papers without a number have
    slots but no starts; null texts and boxes count for nothing; blocks that
    repeat are one place.
    """
    found = settled(without_notices(settled(starts(blocks)), blocks))
    sure = found.where("source = 'read' and at_start and score >= 3")
    unsure = found.where("source = 'read'").join(sure.select("paper_id").distinct(), "paper_id", "left_anti")
    lines = column_lines(sure.unionByName(unsure), blocks)
    heads = settled(headings(blocks))
    at = placed(found, lines)
    first = placed(heads.where(F.col("kind") == "heading"), lines).where(F.col("text").startswith("一")).groupBy("paper_id").agg(F.min(F.struct(*_KEY)).alias("section"))
    after = at.join(first, "paper_id", "left").withColumn("later", F.struct(*_KEY) > F.col("section"))
    opens = after.where("later and source = 'read' and number = 1").select("paper_id").distinct().withColumn("opens", F.lit(True))
    kept = settled(after.join(opens, "paper_id", "left").where("source != 'read' or opens is null or later").drop("section", "later", "opens"))
    chain = settled(numbered(kept.where("source = 'read'"), False))
    many = chain.groupBy("paper_id").count().where("count >= 3").select("paper_id")
    again = column_lines(chain.join(many, "paper_id", "left_semi"), blocks.join(many, "paper_id", "left_semi"))
    lines = settled(lines.join(many, "paper_id", "left_anti").unionByName(again))
    # whoever uses the starts reads them several times, and a chain costs a pass in Python
    return Layout(settled(numbered(placed(kept, lines), True)), slots(blocks, lines), placed(heads, lines), lines)


_CITED = r"^\s*[\[【（(][^\]】）)]{1,96}[\]】）)]\s*"
_SOURCE = rf"(?i)^\s*[\[【（(]\s*(?:20[0-9]{{2}}|[0-9]{{2,4}}\s*年|[^\]】）)]{{0,32}}(?:{'|'.join(SOURCES)}))"
_STEM = rf"^(?:{'|'.join(STEMS)}|在\S{{0,24}}[中上])"
_MARKED = rf"[？?]|[（(]\s*[）)]|{'|'.join(ASKING)}"
_OPTION = r"(?i)(?:^|\s)[A-EＡ-Ｅ]\s*[.．、:]"
_ONE = rf"^\s*1\s+(?=[{_HAN}])"
_NONE = rf"{'|'.join(NO_QUESTION)}|本题共\s*[0-9]+\s*小题|每小题\s*[0-9]+\s*分"


def leading(blocks: DataFrame, layout: Layout) -> DataFrame:
    """Whether a paper's first question lost its number: (paper_id, status, first_number, seq, score, page, col, x, y).

    Of the blocks before the first start, below the first section or else the
    last heading, that with most evidence of a stem counts, the upper one of
    equals: a source, a word that opens a question, a mark, options, length, a
    one without its dot, parts that follow within the same section. It is
    ``repaired`` where the first start is number 2 and the evidence is strong
    and begins with a source or is the first question of the first section;
    ``suspected`` where there is some. Other papers have no row.
    """
    key = F.struct(*_KEY)
    first = layout.starts.groupBy("paper_id").agg(F.min(F.struct(*_KEY, "number")).alias("first")).where("first.number > 1")
    first = first.select("paper_id", F.struct("first.page", "first.col", "first.y").alias("until"), F.col("first.number").alias("first_number"))
    above = layout.headings.where("kind = 'heading'").join(first, "paper_id").where(key < F.col("until"))
    opens = F.when(F.col("text").rlike(r"^\s*一\s*[、.．]"), key)
    cutoff = above.groupBy("paper_id").agg(F.min(opens).alias("section"), F.max(key).alias("last"), F.sort_array(F.collect_set(key)).alias("heads"))
    cx = (F.col("x0") + F.col("x1")) / 2
    lines = placed(textual(blocks), layout.lines, cx).withColumn("y", F.col("y0")).join(first, "paper_id").join(cutoff, "paper_id", "left")
    lines = lines.where((key < F.col("until")) & (F.coalesce("section", "last").isNull() | (key > F.coalesce("section", "last")))).withColumn("text", F.trim(plain()))
    part = F.coalesce(F.size(F.filter("heads", lambda h: h <= key)), F.lit(0))
    by = Window.partitionBy("paper_id").orderBy(*_KEY, "seq")
    lines = lines.withColumn("part", part).withColumn("next", F.collect_list(F.struct("part", "text")).over(by.rowsBetween(0, SUPPORT - 1)))
    lines = lines.withColumn("support", F.array_join(F.transform(F.filter("next", lambda n: n["part"] == F.col("part")), lambda n: n["text"]), "\n"))
    text, support = F.col("text"), F.col("support")
    source, one = text.rlike(_SOURCE), text.rlike(_ONE)
    bare = F.regexp_replace(F.regexp_replace(text, _ONE, ""), _CITED, "")
    more = F.get(F.filter(F.transform(F.slice(F.split(support, "\n"), F.lit(2), F.greatest(F.lit(0), F.size(F.split(support, "\n")) - 1)), F.trim), lambda x: x != ""), F.lit(0))
    body = F.when(source & ~bare.rlike(_STEM) & more.isNotNull(), F.regexp_replace(F.concat(bare, F.lit("\n"), F.regexp_replace(more, _CITED, "")), r"^\s+|\s+$", "")).otherwise(bare)
    lines = lines.withColumns({"source": source, "one": one, "body": body})
    stem, marked, options = F.col("body").rlike(_STEM), F.col("body").rlike(_MARKED), text.rlike(_OPTION)
    has = lambda n: support.rlike(rf"(?m)^\s*[（(]\s*{n}\s*[)）]")
    points = lambda c, n: F.when(c, n).otherwise(0)
    score = points(F.col("source"), 5) + points(stem, 2) + points(marked, 2) + points(options, 2) + points(F.length("body") >= 18, 1) + points(F.col("one"), 2) + points(has(1), 1) + points(has(1) & has(2), 1) - points(text.rlike(_NONE), 8)
    never = F.coalesce(F.col("type") == "equation", F.lit(False)) | text.rlike(rf"(?<![0-9.．A-Za-z\\^_{{])[0-9]{{1,2}}\s*[.．、]{{1,2}}(?![0-9])") | text.rlike(HEADING)
    shaped = ~never & stem & (F.col("source") | marked | options | has(1) | has(2))
    judged = lines.withColumns({"score": F.when(never, -100).otherwise(score), "shaped": shaped, "cited": ~never & F.col("source"), "labelled": text.rlike(r"(?m)^\s*[（(]\s*[12]\s*[)）]")})
    best = F.min_by(F.struct("seq", "score", "shaped", "cited", key.alias("key"), F.col("x0").alias("x")), F.struct(-F.col("score"), *_KEY, "seq"))
    out = judged.groupBy("paper_id").agg(F.min("first_number").alias("first_number"), best.alias("b"), F.bool_or("labelled").alias("labelled"), F.min(F.when(F.col("shaped") & (F.col("score") >= 0), key)).alias("question"), F.first("section").alias("section"))
    sure = (F.col("first_number") == 2) & F.col("b.shaped") & (F.col("b.score") >= REPAIRS) & (F.col("b.cited") | F.coalesce(F.col("section").isNotNull() & (F.col("b.key") == F.col("question")), F.lit(False)))
    status = F.when(sure, "repaired").when(F.col("b.shaped") | (F.col("b.score") >= TOLD) | F.col("labelled"), "suspected")
    return out.select("paper_id", status.alias("status"), "first_number", "b.seq", "b.score", "b.key.page", "b.key.col", "b.x", "b.key.y").where("status is not null")


def with_leading(blocks: DataFrame, layout: Layout) -> Layout:
    """The layout with repaired first questions among its starts, marked as inferred."""
    found = leading(blocks, layout).where("status = 'repaired'")
    first = found.select("paper_id", F.lit(1).alias("number"), "seq", "page", "col", "x", "y", F.col("score").cast("double").alias("score"), F.lit(True).alias("at_start"), F.lit(0).alias("offset"), F.lit("inferred").alias("source"))
    return layout._replace(starts=layout.starts.unionByName(first))


def regions(layout: Layout) -> DataFrame:
    """(paper_id, seq, number, slot, page, x0, y0, x1, y1): each start's boxes up to the next start, heading or boundary.

    The first box begins above the start, but not in a heading that stands right
    there, the last one ends before the next; slivers are dropped. Starts and
    headings are dealt out by paper once.
    """
    start = F.struct("seq", "number", "at_start", "source").alias("start")
    events = layout.starts.select("paper_id", *_KEY, start).unionByName(layout.headings.select("paper_id", *_KEY, F.struct("bottom").alias("head")), True)
    places = events.repartition("paper_id").groupBy("paper_id", *_KEY).agg(F.collect_list("start").alias("starts"), F.collect_list("head.bottom").alias("bottoms"))
    above = F.flatten(F.collect_list(F.when(F.size("bottoms") > 0, F.col("bottoms"))).over(Window.partitionBy("paper_id", "page", "col").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)))
    stops = places.withColumns({"stop": F.lead(F.struct(*_KEY)).over(Window.partitionBy("paper_id").orderBy(*_KEY)), "above": above})
    floor = F.array_max(F.transform(F.filter("above", lambda b: b <= F.col("y") + 2), lambda b: F.least(F.col("y"), b + 1)))
    spans = stops.select("paper_id", *_KEY, "stop", floor.alias("floor"), F.inline("starts"))
    # a stop in a column without content ends the region before the next column that has some
    one = F.struct(F.struct("page", "col").alias("at"), "slot", "x0", "x1", "top", "bottom")
    spans = spans.join(layout.slots.groupBy("paper_id").agg(F.sort_array(F.collect_list(one)).alias("all")), "paper_id")
    own, stop = F.struct("page", "col"), F.struct(F.col("stop.page").alias("page"), F.col("stop.col").alias("col"))
    spans = spans.withColumn("first", F.get(F.filter("all", lambda s: s["at"] == own), F.lit(0))["slot"]).where("first is not null")
    last = F.coalesce(F.array_max(F.transform(F.filter("all", lambda s: s["at"] <= stop), lambda s: s["slot"])), F.when(F.col("stop").isNull(), F.size("all") - 1), F.col("first"))
    spans = spans.withColumn("last", F.greatest(last, F.col("first")))
    cut = spans.withColumn("in", F.explode(F.filter("all", lambda s: s["slot"].between(F.col("first"), F.col("last"))))).drop("all")
    pad = PAD + F.when(F.col("source") == "located", PAD_LOCATED).when(~F.col("at_start"), PAD_INSIDE).otherwise(0.0)
    top = F.when(F.col("in.slot") == F.col("first"), F.greatest(F.col("in.top"), F.col("y") - pad, F.coalesce("floor", F.lit(0.0)))).otherwise(F.col("in.top"))
    bottom = F.when((F.col("in.at.page") == F.col("stop.page")) & (F.col("in.at.col") == F.col("stop.col")), F.least(F.col("in.bottom"), F.col("stop.y") - BEFORE_NEXT)).otherwise(F.col("in.bottom"))
    boxes = cut.withColumns({"x0": F.col("in.x0"), "x1": F.col("in.x1"), "y0": top, "y1": bottom}).where(F.col("y1") - F.col("y0") >= SLIVER)
    return boxes.select("paper_id", "seq", "number", F.col("in.slot").alias("slot"), F.col("in.at.page").alias("page"), *(F.round(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")))


def questions(blocks: DataFrame, layout: Layout) -> DataFrame:
    """(paper_id, number, seq, section, text): each start with the text up to the next start or heading, and the section above it.

    Lines, starts and headings are dealt out by paper once.
    """
    order = ["page", "col", "y", "rank", "seq"]
    cx = (F.col("x0") + F.col("x1")) / 2
    lines = textual(blocks).select("paper_id", "page", F.lit(None).cast("int").alias("col"), F.col("y0").alias("y"), F.lit(1).alias("rank"), "seq", cx.alias("cx"), plain().alias("text"))
    begins = layout.starts.select("paper_id", *_KEY, F.lit(0).alias("rank"), "seq", F.struct("seq", "number").alias("start"))
    none = F.struct(F.lit(-1).alias("seq"), F.lit(-1).alias("number"))
    stops = layout.headings.select("paper_id", *_KEY, F.lit(0).alias("rank"), "seq", none.alias("start"), F.when(F.col("kind") == "heading", F.col("text")).alias("section"))
    rows = _lined(lines.unionByName(begins, True).unionByName(stops, True).repartition("paper_id"), layout.lines)
    rows = rows.withColumn("col", F.when(F.col("rank") == 1, _column(F.col("cx"))).otherwise(F.col("col"))).drop("lines")
    # a block in which another start stands is cut there
    inner = layout.starts.where("offset > 0").repartition("paper_id").groupBy("paper_id", "seq").agg(F.sort_array(F.collect_set(F.struct("offset", "y"))).alias("inner"))
    inner = inner.where("seq is not null").groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("seq", "inner"))).alias("_blocks"))
    whole = F.array(F.struct(F.lit(0).alias("offset"), F.col("y").alias("y")))
    cuts = F.when(F.col("rank") == 1, F.concat(whole, F.coalesce(F.try_element_at("_blocks", "seq"), F.array().cast("array<struct<offset:int,y:double>>")))).otherwise(whole)
    rows = rows.join(inner, "paper_id", "left").withColumn("cuts", cuts).drop("_blocks", "y")
    rows = rows.select("*", F.posexplode("cuts").alias("k", "cut"))
    until = F.coalesce(F.get("cuts", F.col("k") + 1)["offset"], F.length("text"))
    part = F.substr("text", F.col("cut.offset") + 1, until - F.col("cut.offset"))
    rows = rows.select("paper_id", "page", "col", F.col("cut.y").alias("y"), "rank", "seq", F.regexp_replace(part, r"\n$", "").alias("text"), "start", "section")
    by = Window.partitionBy("paper_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    owned = rows.withColumns({"owner": F.last("start", True).over(by), "section": F.last("section", True).over(by)}).where("owner.seq >= 0")
    texts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(*order, "text"))))
    out = owned.groupBy("paper_id", "owner").agg(texts.alias("t"), F.min_by("section", F.struct(*order)).alias("section"))
    return out.select("paper_id", F.col("owner.number").alias("number"), F.col("owner.seq").alias("seq"), "section", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))
