"""Facet counts against counting each facet on its own."""

from collections import Counter
from itertools import product

from lodeweave.operators import facets
from lodeweave.operators.filters import FilterSpec

COLUMNS = "id long, paper_id string, kind string, review_source string, answer string, body_mode string, status string, search_text string"


def test_each_facet_ignores_its_own_filter(spark):
    parts = product(("p", "q", None), ("en", "xx", None), ("human", None), ("yes", " ", None), ("image", "text", None))
    data = [(k, *part, "published" if k % 5 else "withdrawn", "word" if k % 3 else "none") for k, part in enumerate(parts)]
    pubs = spark.createDataFrame(data, COLUMNS)
    links = spark.createDataFrame([(k, "t", False) for k in range(0, len(data), 2)], "publication_id long, tag_id string, needs_review boolean")
    edges = spark.createDataFrame([], "parent string, child string, relation string")
    passes = {
        "paper": lambda r: r[1] == "p",
        "kind": lambda r: r[2] == "en",
        "review_source": lambda r: r[3] == "human",
        "answer": lambda r: bool(r[4]),
        "body_mode": lambda r: r[5] in (None, "text"),
    }
    shown = {
        "paper": lambda r: r[1],
        "kind": lambda r: r[2] if r[2] == "en" else "other",
        "review_source": lambda r: r[3] or "none",
        "answer": lambda r: "yes" if (r[4] or "").strip() else "no",
        "body_mode": lambda r: "image" if r[5] == "image" else "text",
    }
    values = {"paper": "p", "kind": "en", "review_source": "human", "answer": "yes", "body_mode": "text"}
    for used in ([], ["kind"], ["paper", "answer"], list(values)):
        spec = FilterSpec(q="word", tag_any=("t",), **{f: values[f] for f in used})
        base = [r for r in data if r[0] % 5 and r[0] % 3 and r[0] % 2 == 0]
        wanted = Counter((f, shown[f](r)) for f in values for r in base if all(passes[g](r) for g in used if g != f))
        got = {(r.facet, r.value): r["count"] for r in facets.facet_counts(pubs, spec, links, edges).collect()}
        assert got == dict(wanted)
