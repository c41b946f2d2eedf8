"""Phrases, periodic runs and main texts against plain versions of their definitions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from compare import rows
from pyspark.sql import functions as F

from lodeweave.llm import collocations, pages, periodic, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def phrases(docs, least=10, reported=2000):
    """The contract, phrase by phrase."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    out = []
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, ws), a in candidates.items():
        if len(ws) == 2 and any(100 * b >= 50 * a for (g, xs), b in candidates.items() if g == lang and len(xs) == 3 and ws in (xs[:2], xs[1:])):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.append((lang, -score, -a, " ".join(ws).encode(), left, right))
    ranked, last = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        last[lang] += 1
        if last[lang] <= reported:
            ranked.append((lang, last[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


@pytest.mark.parametrize("seed", range(3))
def test_phrases_equal_plain_counts(spark, seed, monkeypatch):
    monkeypatch.setattr(collocations, "_BLOCK", 300)
    dice = random.Random(seed)
    words = ["a", "B", "b", "é", "É", "|", "x\x1cy", "\xa0", "z" * 50]
    docs = [(None if dice.random() < 0.2 else dice.choice(["en", "de f"]), None if dice.random() < 0.1 else dice.choice(["", " "]).join(dice.choice(words) + dice.choice([" ", " ", " ", "\t ", ". ", "\n", "\r\n", "?"]) for _ in range(dice.randrange(40)))) for _ in range(60)]
    docs += [("en", "a b a b a b a b a b a b a b a b a b a b a b"), ("en", ""), ("", "q q q q q q q q q q q q q q")]
    df = spark.createDataFrame([(i, t, lang, None, 0) for i, (lang, t) in enumerate(docs)], DOCS).repartition(3)
    for least, reported in ((10, 2000), (3, 4)):
        found = sorted(tuple(r) for r in collocations.mine(df, least=least, reported=reported).collect())
        assert found == phrases(docs, least, reported)


def test_phrases_of_no_rows(spark):
    assert collocations.mine(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.mine(spark.createDataFrame([(1, None, None, None, 0)], DOCS)).collect() == []


def test_bitmap_has_all_frequent_phrases(spark):
    df = spark.createDataFrame([("en", f"w{i} é{i}") for i in range(5000)], "lang string, phrase string")
    bits = collocations.bitmap(df, 2)
    block = collocations.Block("en", [f"w{i} é{i}.".encode() for i in range(5000)])
    assert block.counted([np.full(1 << 12, 255, np.uint8), bits]).num_rows == 0  # no three words
    h = collocations.hashes(block.names, "en")
    at = {n.decode(): i for i, n in enumerate(block.names.to_pylist())}
    assert (collocations.hashes(block.names.slice(7, 50), "en") == h[7:57]).all() and len(set(h.tolist())) == len(h)
    pairs = np.array([h[at[f"w{i}"]] ^ collocations._turned(h[at[f"é{i}"]], 1) for i in range(5000)])
    assert collocations._lets(bits, pairs).all()
    assert collocations._lets(bits, h).mean() < 0.2  # others mostly not


def test_phrases_are_shuffled_in_parts(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 97 + k * k) % 5000}" for k in range(400)), "en", None, 0) for i in range(200)], DOCS).repartition(2).cache()
    docs.count()
    stages = lambda: sum(s.shuffleWriteRecords() for s in _seq(spark, spark.sparkContext._jsc.sc().statusStore()))
    before = stages()
    assert collocations.mine(docs, least=400).collect() == []
    assert stages() - before < 1000  # 5,000 words in each of two blocks: a row for each bucket, not for each phrase
    docs.unpersist()


def _seq(spark, store):
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [stages.apply(i) for i in range(stages.size())]


def test_equal_hashes_keep_phrases_apart():
    part = lambda *rows: pa.RecordBatch.from_arrays([pa.array([7] * len(rows), pa.uint64()), pa.array([p for p, _ in rows], pa.string()), pa.array([f for _, f in rows], pa.int64())], schema=collocations._PART).serialize().to_pybytes()
    rows = pa.table({"lang": ["en", "de", "en"], "part": pa.array([part(("a b", 6), ("a c", 5), (None, 1)), part(("a b", 9)), part(("a c", 5), ("a b", 3), (None, 2))], pa.binary())})
    found = sorted(map(tuple, (r.values() for r in collocations.summed(rows, 10).to_pylist())), key=str)
    assert found == [("en", "a c", 10), ("en", None, 3)]


def plain_runs(ws):
    out = []
    for q in range(1, len(ws) // 3 + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                part = ws[i : i + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_plain_search():
    dice = random.Random(5)
    for _ in range(1500):
        n, kinds = dice.randrange(170), dice.choice([1, 2, 2, 3, 5, 30])
        ws = [dice.randrange(kinds) for _ in range(n)]
        for _ in range(dice.randrange(4)):
            if n > 5:
                a, b = sorted(dice.sample(range(n), 2))
                p = dice.randint(1, max(1, (n - a) // 3))
                for i in range(a, b):
                    ws[i] = ws[a + (i - a) % p]
        ids = np.array(ws, np.int64)
        assert periodic.runs(ids) == plain_runs(ws)
        counts = periodic.lag_counts(ids, n // 3)
        assert counts[1:].tolist() == [sum(ws[i] == ws[i + q] for i in range(n - q)) for q in range(1, n // 3 + 1)]


def test_runs_of_long_texts(monkeypatch):
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    ids = np.arange(300_000) % 1000
    assert periodic.runs(ids) == [(0, 300_000, 1000)]
    counts = periodic.lag_counts(ids[:30_000], 10_000)
    monkeypatch.setattr(periodic, "_PAIRS", 1000)
    monkeypatch.setattr(periodic, "_CELLS", 1)
    assert (periodic.lag_counts(ids[:30_000], 10_000) == counts).all() and counts[1000] == 29_000
    tail = np.concatenate((np.arange(5000), 7000 + np.arange(40_000) % 13_000))
    assert periodic.runs(tail) == [(5000, 40_000, 13_000)]


def _expected(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(ws)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    found = plain_runs(ws)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_runs_query_equals_plain_version(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in docs if len(t or "") < 12_000]  # the plain version takes the square of the length
    assert len(short) > 0.9 * len(docs)
    found = {r.doc_id: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(found) == len(docs)
    for i, t in short:
        r = found[i]
        assert (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == _expected(i, t)
    assert sum(r.n_runs > 0 for r in found.values()) > len(docs) / 20


def test_runs_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (None, "a " * 30, 1), (7, "", 2), (7, " x\x1c " * 40, 2), (7, " x\x1c " * 40, 2)], "doc_id long, text string, runs int")
    found = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.collapse(df).collect()]
    assert found == [(None, [], ""), (None, [(0, 30, 1)], "a"), (7, [], ""), (7, [(0, 40, 1)], " x\x1c"), (7, [(0, 40, 1)], " x\x1c")]
    assert periodic.collapse(df.limit(0)).collect() == []


PAGE = """<html><body class="has-sidebar"><header class="site-header"><h1>Site</h1><p>tag line here</p></header><div id="cookie-notice"><p>We use cookies to make this site
better for all of you, you may accept.</p></div><div class="sidebar"><p>About the author, who has been writing for years on this site about a number of things.</p></div>
<div class="content"><h2>Title&nbsp;of it</h2><p>Short.</p><p>A much longer paragraph, with a <a href="x>y">link here</a> and a number of words &amp; more, until it is done.</p><ul><li>one thing</li>
<li><a>two</a></li></ul><aside><p>Related things that might be of interest to someone else reading this</p></aside><p>Last<br>words.<!-- <p>not this</p> --></p><form><label>Mail</label><input></form></div>
<script>document.write("<p>nor this</p>")</script><section id="comments"><article class="comment"><p>I like this a lot, it is a great article, and I read it all, thanks for that.</p></article></section>
<div style="display:none">hidden words</div><footer>c</footer></body></html>"""
TEXT = "Title of it\nShort.\nA much longer paragraph, with a link here and a number of words & more, until it is done.\none thing\ntwo\nLast words."


def _article(html):
    """Main text of the tables' pages, whose only article element holds it."""
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)(?:</article>|$)", html or "", re.S)[1])
    texts = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts)
    return "\n".join(t for t in texts if t)


def test_main_text_of_all_pages(spark, sf):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = queries.op12_html_extraction(spark, sf).collect()
    assert len(found) == len(html)
    for r in found:
        assert r.text == _article(html[r.page_id]) and r.n_chars == len(r.text)


def test_main_text_of_odd_pages(spark):
    line = " ".join(["word"] * 40) + "."
    cases = [
        (PAGE, TEXT),
        (None, ""),
        ("", ""),
        ("<", "<"),
        ("<p", ""),
        ("plain text", "plain text"),
        ("<script>" + "x" * 100, ""),
        ("<!-- never closed <p>x</p>", ""),
        (f"<div><a href=1>Home</a> | <a href=2>News</a></div><div><p>{line}<p>Word.<p>{line}</div><div><a href=1>Imprint</a> <a>Terms</a></div>", f"{line}\nWord.\n{line}"),
        (f"<main><div class=\"share-buttons\">Share</div><p>{line}</p><div class=ad>{line}</div></main><p>{line}</p>", line),
        ("<article>" + "<b><p>x" * 3000 + "</article>", "\n".join(["x"] * 3000)),
        ("<article><p title=\"unclosed>x</p><p>y &lt;p&gt; &copy &#233;</p>", None),
    ]
    df = spark.createDataFrame([(i, h, "was") for i, (h, _) in enumerate(cases)], "page_id long, html string, text string")
    found = {r.page_id: r for r in pages.extract(df).collect()}
    for i, (_, wanted) in enumerate(cases):
        if wanted is not None:
            assert found[i].text == wanted, i
    assert found[11].text.endswith("y <p> © é")
    assert pages.extract(df.limit(0)).collect() == []


def test_tree_is_that_of_the_model(spark):
    model = pages.fit(spark)
    blocks = spark.createDataFrame(pages.labelled(), "features array<double>, label double")
    from pyspark.ml.functions import array_to_vector

    both = model.transform(blocks.select(array_to_vector("features").alias("features"), F.col("features").alias("raw"), "label"))
    same = both.select((F.col("prediction") == 1).alias("a"), pages.rule(model, F.col("raw")).alias("b"), (F.col("label") == 1).alias("label")).collect()
    assert all(r.a == r.b for r in same) and sum(r.b == r.label for r in same) > 0.95 * len(same)
    with pytest.raises(ValueError):
        pages.fit(spark, [([0.0] * 13, 0.0)] * (pages.MOST_LABELLED + 1))


def test_phrases_equal_sql(spark, sf, duck):
    assert rows(queries.op11_collocations(spark, sf).toPandas()) == rows(duck.execute(collocations.ORACLE).df())
