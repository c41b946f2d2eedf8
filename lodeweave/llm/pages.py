"""Main text of web pages: flat blocks, told apart by a decision tree.

A page is cut into blocks of text at block elements. Each block has its number
of words and the share of them inside links, those of its neighbours, and where
it stands: its kind and the nearest element that names its part of the page. A
decision tree over these, trained by Spark ML on the small table ``LABELLED``,
says which blocks are main text. The tree becomes a column expression, so a page
is parsed, judged and joined in one pass without a shuffle.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, without

#: Elements that start and end a block of text; all others stand within one.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style title noscript noframes iframe template textarea svg math object audio video canvas xmp".split())

#: Elements, and words of a class, id or role, that name a part of the page. What stands in
#: ``NEVER`` is not main text whatever is in it; ``REST`` yields to an article inside it.
MAIN_TAGS, NEVER_TAGS = frozenset(["article", "main"]), frozenset("nav footer aside form menu dialog button select fieldset".split())
MAIN_NAMES = frozenset("article articlebody content entry main maincontent post story".split())
NEVER_NAMES = frozenset("ad ads adsense advert advertisement adverts advertising comment comments commentlist consent cookie cookies discussion disqus gdpr newsletter popup modal reply replies respond signup sponsor sponsored subscribe subscription".split())
REST_NAMES = frozenset("alert banner bottom breadcrumb breadcrumbs contentinfo footer header legal login masthead menu nav navbar navigation notice notices notification pagination pager promo promotion related search share sharing sidebar side social teaser toolbar topbar widget widgets complementary".split())

#: Where a block stands: nowhere named, in the main part, in the rest, in what is never main, in a main part inside the rest.
NOWHERE, MAIN, REST, NEVER, INSIDE = range(5)
#: What a block is.
TEXT, HEADING, ITEM = range(3)

FEATURES = ["words", "linked", "words_before", "linked_before", "words_after", "linked_after", "main", "rest", "never", "inside", "heading", "item", "page_has_main"]

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<[!?/a-zA-Z][^>]*+(?:>|\Z)|[^<]++|<""", re.S)
_NAME = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _named(tag: str, attributes: str) -> int:
    """The part of the page that an element names."""
    if tag in NEVER_TAGS or attributes and _HIDDEN.search(attributes):
        return NEVER
    named = NOWHERE
    if attributes and tag not in ("html", "body"):
        for _, value in _NAME.findall(attributes):
            for name in value.strip("\"'").split():
                parts = [p.lower() for p in _PARTS.findall(name)]
                if not parts or {"has", "no", "with", "without"} & set(parts):
                    continue
                ends = {"".join(parts), parts[0], parts[-1]}
                if ends & NEVER_NAMES:
                    return NEVER
                found = REST if ends & REST_NAMES else MAIN if ends & MAIN_NAMES else NOWHERE
                named = max(named, found)
    if tag in MAIN_TAGS:
        return MAIN
    return named or (REST if tag == "header" else NOWHERE)


def _within(outer: int, named: int) -> int:
    """Where what stands in ``named`` stands, if that itself stands in ``outer``."""
    if NEVER in (outer, named):
        return NEVER
    if outer == NOWHERE or named == NOWHERE:
        return outer or named
    if named == MAIN:
        return INSIDE if outer in (REST, INSIDE) else MAIN
    return REST


def blocks(html: str | None) -> list[dict]:
    """The blocks of a page in order, each with its text, words, words in links, kind and place."""
    page, out = html or "", []
    stack: list[tuple[str, int]] = []
    open_tags: dict[str, int] = {}
    parts: list[tuple[str, bool]] = []
    place, links, kind = NOWHERE, 0, TEXT

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(t for t, _ in parts)).split())
            if text:
                inside = sum(len(unescape(t).split()) for t, linked in parts if linked)
                out.append({"text": text, "words": len(text.split(" ")), "linked": inside, "kind": kind, "place": place})
            parts.clear()

    def close(tag: str) -> None:
        nonlocal place, links, kind
        while True:
            last, before = stack.pop()
            open_tags[last] -= 1
            if last == "a":
                links -= 1
            if last == tag:
                break
        place = before
        kind = HEADING if any(open_tags.get(f"h{k}") for k in range(1, 7)) else ITEM if open_tags.get("li") else TEXT

    at = 0
    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        start, end = token[1], token[3]
        if start:
            tag, attributes = start.lower(), token[2]
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
                parts.append((" ", False))
                continue
            if tag in BLOCKS:
                flush()
                if open_tags.get("p"):
                    close("p")  # a paragraph ends where a block starts
            if tag == "br":
                parts.append((" ", False))
            if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
                continue
            if tag == "a" and links:
                close("a")
            stack.append((tag, place))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            place = _within(place, _named(tag, attributes))
            links += tag == "a"
            if tag in BLOCKS:
                kind = HEADING if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else ITEM if open_tags.get("li") else TEXT
        elif end:
            tag = end.lower()
            if tag in BLOCKS:
                flush()
            if open_tags.get(tag):
                close(tag)
        elif token[0][0] != "<" or token[0] == "<":
            parts.append((token[0], links > 0))
    flush()
    return out


def featured(found: list[dict]) -> list[dict]:
    """Blocks with the features of ``FEATURES``; beyond the ends stand empty neighbours."""
    has_main = float(any(b["place"] in (MAIN, INSIDE) for b in found))
    share = [min(1.0, b["linked"] / b["words"]) for b in found]
    out = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        values = [b["words"], share[i], before["words"] if before else 0, share[i - 1] if before else 0, after["words"] if after else 0, share[i + 1] if after else 0]
        values += [b["place"] == p for p in (MAIN, REST, NEVER, INSIDE)] + [b["kind"] == HEADING, b["kind"] == ITEM, has_main]
        out.append(b | {"features": [float(v) for v in values]})
    return out


#: The labelled table: a page a line, a block a word, as place kind words linked label.
#: Places: o nowhere, m main, r rest, n never, i main inside the rest. Kinds: p text, h heading, l item. Label + is main text.
LABELLED = """
nl1,1- nl2,2- np9,0- mh11,0+ mp60,0+ mp1,0+ mp3,0+ mp120,0+ mp24,1+ mp90,0+ mp95,0+ mp2,0+ mp210,0+ mp40,0+ mp70,0+ np14,1-
rp6,4- nl1,1- rp40,0- mh7,0+ mp35,0+ mp110,0+ ml4,0+ ml9,0+ ml2,2+ mp18,18+ mp80,2+ np30,0- np55,0- nh2,0- np70,3-
rp3,3- rl1,1- np25,2- ih5,0+ ip48,0+ ip2,0+ ip90,6+ ip130,0+ ip60,0+ rh3,0- rp90,0- rl7,7- np40,0- rp15,4-
op2,2- op2,0- oh8,0+ op45,0+ op80,3+ op100,0+ op38,0+ op5,0+ op66,0+ op4,4- op3,0- op3,3-
op1,1- op2,0- op30,0+ op12,0+ op70,0+ op7,0+ op90,1+ op120,0+ op52,0+ op2,0- op4,4-
ol1,1- ol1,1- oh6,0+ op30,0+ ol12,0+ ol15,1+ ol9,0+ op70,0+ oh3,0+ op52,0+ ol4,4- op11,2-
nl1,1- op7,0- mh4,0+ mp22,0+ mp200,9+ mp6,0+ mp150,0+ mp88,0+ mh2,0+ mp75,0+ op8,0- op40,0- np90,0-
nl2,2- rp30,1- mp3,0+ mp2,2+ mp1,0+ np45,0- np3,0- mp44,0+ mp9,0+ mp25,0+ mp115,0+ rp20,20- rp9,2-
op150,0+
op90,4+ op60,0+ op1,0+ op45,0+
op2,2- oh5,0+ op60,9+ op30,7+ op80,20+ op45,5+ op4,4- op12,9- op30,26-
op1,1- op70,12+ op25,5+ op50,4+ op16,16- op9,6-
op3,0+
op2,0+
op1,0+
oh5,0+ op3,0+ op85,0+ np80,0- np30,0- op40,0+ op6,6-
mh3,0+ ml1,1+ ml2,0+ ml30,0+ np12,12- np120,0- rp80,0- op60,0- op3,0-
rh4,4- rp12,1- ih9,0+ ip12,0+ ip4,4+ ip33,0+ ip1,0+ rp66,5- rl2,2- nl3,3- np9,0-
np60,0- np100,0- mp100,0+ mp30,0+ mp100,0+ mp8,3+ mp60,0+ mp31,0+ op60,0- rp100,0-
""".strip()


#: Rows of a labelled table at most.
MOST_LABELLED = 100_000


def labelled() -> list[tuple[list[float], float]]:
    """(features, label) of the labelled table."""
    out = []
    for page in LABELLED.splitlines():
        rows = []
        for word in page.split():
            words, linked = word[2:-1].split(",")
            rows.append({"place": "omrni".index(word[0]), "kind": "phl".index(word[1]), "words": int(words), "linked": int(linked), "label": float(word[-1] == "+")})
        out += [(b["features"], b["label"]) for b in featured(rows)]
    return out


def fit(spark: SparkSession, rows: list[tuple[list[float], float]] | None = None, depth: int = 8):
    """A decision tree over labelled blocks, those of ``LABELLED`` by default.

    ``rows`` is a table that someone labelled by hand, so it is small; more than
    ``MOST_LABELLED`` rows are refused.
    """
    rows = labelled() if rows is None else rows
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"label at most {MOST_LABELLED} blocks")
    table = spark.createDataFrame([(Vectors.dense(x), y) for x, y in rows], ["features", "label"])
    return DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=1, seed=7).fit(table.coalesce(1))


def rule(model, features: Column) -> Column:
    """The tree as a column: the class of a block by its array of features."""

    def of(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction() >= 0.5)
        split = node.split()
        left = F.get(features, F.lit(split.featureIndex())) <= split.threshold()
        return F.when(left, of(node.leftChild())).otherwise(of(node.rightChild()))

    return of(model._call_java("rootNode"))


_BLOCK = pa.struct([("text", pa.string()), ("words", pa.int32()), ("linked", pa.int32()), ("kind", pa.int32()), ("place", pa.int32()), ("features", pa.list_(pa.float64()))])


def extract(pages: DataFrame, model=None, html: str = "html") -> DataFrame:
    """``pages`` plus ``blocks``, all blocks with their features and ``is_main``, and ``text``, the main ones joined by line ends.

    Character references are decoded, white space inside a block is one space.
    A null or empty page has no blocks and an empty text; pages that repeat are
    judged each; columns of these names are replaced. ``model`` is what
    :func:`fit` gives for other labels.
    """

    @F.arrow_udf("array<struct<text:string,words:int,linked:int,kind:int,place:int,features:array<double>>>")
    def parsed(htmls: pa.Array) -> pa.Array:
        return pa.array([featured(blocks(x)) for x in htmls.to_pylist()], pa.list_(_BLOCK))

    model = model or fit(pages.sparkSession)
    (found,) = fresh(pages, "found")
    judged = F.transform(F.col(found), lambda b: b.withField("is_main", rule(model, b["features"])))
    out = pages.withColumn(found, parsed(F.col(html))).select(*without(pages, "blocks", "text"), judged.alias("blocks"))
    return out.withColumn("text", F.array_join(F.transform(F.filter("blocks", lambda b: b["is_main"]), lambda b: b["text"]), "\n"))
