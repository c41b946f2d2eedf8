"""Bundles are whole and read back; OCR archives tolerate what is malformed."""

import pytest

from lodeweave.sources import bundles


def test_round_trip(spark, tmp_path):
    a, b = spark.range(7).withColumnRenamed("id", "a"), spark.createDataFrame([("x", None)], "k string, v int")
    assert bundles.write_bundle({"a": a, "b": b}, str(tmp_path / "bundle")) == {"a": 7, "b": 1}
    back = bundles.read_bundle(spark, str(tmp_path / "bundle"))
    assert sorted(r.a for r in back["a"].collect()) == list(range(7))
    assert back["b"].collect() == b.collect()
    assert [p.name for p in tmp_path.iterdir()] == ["bundle"]


def test_failed_bundle_leaves_no_target(spark, tmp_path):
    from pyspark.sql import functions as F

    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        bundles.write_bundle({"bad": bad}, str(tmp_path / "bundle"))
    assert not (tmp_path / "bundle").exists()


def test_ocr_blocks(spark):
    rows = [(1, '[{"type":"text","page":0,"bbox":[10,20,30,40],"text":"a","width":100,"height":200},{"type":"table","page":1,"bbox":[0,0,50,50],"text":null,"width":100,"height":100}]'), (2, "not json"), (3, None), (4, "[]")]
    got = bundles.ocr_blocks(spark.createDataFrame(rows, "doc_id long, content string")).orderBy("seq").collect()
    assert [(r.doc_id, r.seq, r.type, r.bbox) for r in got] == [(1, 0, "text", [100.0, 100.0, 300.0, 200.0]), (1, 1, "table", [0.0, 0.0, 500.0, 500.0])]
    assert bundles.ocr_tables(spark.createDataFrame(rows, "doc_id long, content string")).count() == 1
