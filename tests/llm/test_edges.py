"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from lodeweave.llm import audio, collocations, copies, licenses, lines, mixing, packing, pages, periodic, repeats, simhash, toxicity, urls, weighted

LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "Some text under the MIT License here, you idiot.\nShared line of boilerplate.", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, LONG, "en", "a", len(LONG)),
    (5, "tied text here", "en", "c", 14),
    (6, "tied text here", "en", "c", 14),
    (7, "repeated row", "en", "c", 12),
    (7, "repeated row", "en", "c", 12),
    (8, " \n\t ", "en", "c", 4),
    (None, "a row without an id", "en", "c", 19),
    (9, "ünïcødé 漢字 🙂 text", "xx", "", 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names of results, and of working columns, with and without underscores.
CLASH = ["toxicity", "n_lines", "repeats", "target", "kept", "labels", "score", "hits", "media", "component_id", "fp"]
OWN = ["_t", "_copy", "_judged", "_size", "_target", "_times", "_last", "_s", "_doc", "_text", "_h", "_w", "_c", "_d", "_id", "_gone", "_kept", "_set", "_root", "_f", "_ranges", "one", "two", "row", "own", "size", "times", "last", "goal", "hash", "of", "name", "gone", "kept_text", "judged", "words", "starts", "doc", "h", "rest", "_host", "_rest", "_m", "found", "match", "ranked_host"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.withColumns({c: F.lit(f"mine {c}") for c in (*CLASH, *OWN)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (5, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def _as_pages(d):
    """Texts as pages, some of which link to others."""
    return d.withColumns({"url": F.concat(F.lit("http://a.example.net/en/"), F.col("doc_id")), "html": F.concat(F.lit("<a href='http://b.example.com/de/'>x</a><p>"), F.col("text"))})


OPERATORS = {
    "judge": lambda d, lab: urls.judge(_as_pages(d)),
    "extract": lambda d, lab: pages.extract(_as_pages(d)),
    "collapse": lambda d, lab: periodic.collapse(periodic.seeded(d)),
    "mine": lambda d, lab: collocations.mine(d),
    "toxicity": lambda d, lab: toxicity.score(d, lab),
    "keep_clean": lambda d, lab: toxicity.keep_clean(d, lab),
    "simhash": lambda d, lab: simhash.near_duplicates(d),
    "keep_one": lambda d, lab: copies.keep_one(d),
    "audio": lambda d, lab: audio.analyse(audio.store(d)),
    "digest": lambda d, lab: d.select("doc_id", audio.digest(F.col("text")).alias("d")),
    "lines": lambda d, lab: lines.clean_lines(d),
    "mix": lambda d, lab: mixing.mix(d),
    "sample": lambda d, lab: mixing.sample(d),
    "pack": lambda d, lab: packing.pack(d),
    "weighted": lambda d, lab: weighted.edited_and_next(d),
    "repeats": lambda d, lab: repeats.remove_repeats(d),
    "licenses": lambda d, lab: licenses.scan(d),
}
KEEP_COLUMNS = {"judge", "extract", "collapse", "toxicity", "keep_clean", "keep_one", "audio", "lines", "mix", "sample", "repeats", "licenses"}
SAME_ROWS = {"judge", "extract", "collapse", "toxicity", "simhash", "audio", "digest", "lines", "mix", "weighted", "repeats", "licenses"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(name, docs, labels):
    got = OPERATORS[name](docs, labels).collect()
    if name in SAME_ROWS:
        assert len(got) == len(ROWS)
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
        if name != "weighted":  # there, rows that repeat follow each other
            assert len({tuple(map(str, r)) for r in got if r["doc_id"] == 7}) == 1


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, empty, labels):
    assert OPERATORS[name](empty, labels).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(name, wide, docs, labels):
    got = OPERATORS[name](wide, labels)
    assert name not in KEEP_COLUMNS or {*OWN} <= {*got.columns}
    assert len(got.columns) == len({c.lower() for c in got.columns})
    assert got.count() == OPERATORS[name](docs, labels).count()
    # What the caller calls by a working column's name comes back as it was.
    for c in {*OWN} & {*got.columns} if name in KEEP_COLUMNS else ():
        assert {r[c] for r in got.select(c).distinct().collect()} == {f"mine {c}"}, c


def test_stages_keep_the_columns(spark, docs, tmp_path, labels, empty):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (docs, empty):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == start.columns
                assert [f.dataType for f in out.schema] == [f.dataType for f in start.schema]
                out.write.mode("overwrite").parquet(str(tmp_path / name))
                now = spark.read.parquet(str(tmp_path / name))
            else:
                assert out.count() >= (0 if start is empty else 1)


def test_pages(spark):
    rows = [(1, None, None), (2, "no scheme", "<a href='http://x.org/'>"), (3, "http://Sub.Example.NET/en/x?q", ""), (4, "https://example.com/de/1#t", '<a href="http://b.example.org/fr/">'), (4, "https://example.com/de/1#t", '<a href="http://b.example.org/fr/">'), (5, "ftp://net", ""), (6, "http://a.b.org/fr/x", ""), (7, "http://xnet/", ""), (8, "http://net/?x", "")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine"))).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow")
    assert (got[2].host, got[2].path) == ("", "")
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("sub.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[4].rule, got[4].verdict) == ("example.com/de/", "block")
    assert (got[5].host, got[5].path, got[5].rule) == ("net", "", None)
    assert (got[6].rule, got[6].verdict) == ("org/fr/", "allow")
    assert got[7].rule is None
    assert (got[8].rule, got[8].path) == ("net/", "/")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_stored_media_reads_back():
    for data in (b"", b"x", bytes(64), bytes(range(256)) * 3):
        payload = audio.padded(data)
        assert len(payload) % 64 == 0 and payload[: len(data)] == data and len(payload) >= 64
        rate, back = audio.read_wav(audio.write_wav(payload))
        assert rate == audio.RATE and bytes(back) == payload
    with pytest.raises(ValueError, match="WAV"):
        audio.read_wav(b"nothing of the kind")
    assert hashlib.sha256(audio.write_wav(bytes(64))).hexdigest() == hashlib.sha256(audio.write_wav(bytes(64))).hexdigest()


def test_one_phrase_fills_a_long_text(spark):
    """Time grows with the words, not with their square: 4 MB of one licence phrase, and of near misses."""
    n = 180_000
    texts = ["Under the MIT License " * n, "under the mit the license " * n]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (4 * n, n, 0, 4 * (n - 1), "mit")
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (5 * n, 0, None, "", 0)


def test_licences_by_their_key_phrases(spark):
    """A label needs all mandatory phrases of a template, in any order; the score is the share of its phrases."""
    granted = "Permission is hereby granted, free of charge, to any person obtaining a copy"
    as_is = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND"
    notice = "The above copyright notice and this permission notice shall be included in all copies"
    texts = {
        f"{granted} of it. {notice}. {as_is}": ("mit", 1.0),
        f"{as_is} {granted}": ("mit", 2 / 3),
        granted: ("", 1 / 3),
        "Redistribution and use in source and binary forms may be used to endorse or promote products derived from this software": ("bsd-3", 2 / 3),
        "Under the MIT license, all rights reserved": ("all-rights-reserved,mit", 1.0),
        "GNU General Public License as published by the Free Software Foundation": ("gpl", 0.5),
        "GNU General Public License": ("", 0.25),
        "Permission is hereby granted, free of charge, to no person obtaining a copy": ("", 0.0),
        "": ("", 0.0),
    }
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, (labels, score) in enumerate(texts.values()):
        assert got[k] == (labels, pytest.approx(score)), k
