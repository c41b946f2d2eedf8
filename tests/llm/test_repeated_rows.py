"""Rows that share doc_id and text are one document to the long repeats."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from lodeweave.llm import repeats


def test_repeated_rows_keep_their_text(spark):
    one, two, three = (" ".join(f"{k}word{i}" for i in range(40)) for k in "abc")
    rows = [(1, one), (1, one), (None, two), (None, two), (2, one + three), (2, one + three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 4):
        got = sorted((str(r.doc_id), r.kept.decode()) for r in repeats.remove_repeats(docs.repartition(parts)).collect())
        assert got == sorted([("1", one)] * 2 + [("None", two)] * 2 + [("2", three)] * 2)
