"""Job streams run to the end of what is there and agree with batch results."""

from compare import rows
from pyspark.sql import functions as F

from lodeweave.sources.tables import load
from lodeweave.streaming import jobs


def _folder(spark, sf, tmp_path):
    events = load(spark, sf, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "events"))
    return events, str(tmp_path / "events")


def test_windowed_counts(spark, sf, tmp_path):
    events, folder = _folder(spark, sf, tmp_path)
    stream = jobs.stream(spark, folder, events, late="100 days")
    got = jobs.drain(jobs.counts_by_window(stream), str(tmp_path / "c1"), "win", "complete")
    assert rows(got.toPandas().round(6)) == rows(jobs.counts_by_window(events).toPandas().round(6))


def test_reuse_within_watermark(spark, sf, tmp_path):
    events, folder = _folder(spark, sf, tmp_path)
    stream = jobs.stream(spark, folder, events, late="100 days")
    got = jobs.drain(jobs.reuse(stream).select("job_id", "kind"), str(tmp_path / "c2"), "once")
    assert rows(got.toPandas()) == rows(events.select("job_id", "kind").distinct().toPandas())


def test_leases_hold(spark, sf, tmp_path):
    events, folder = _folder(spark, sf, tmp_path)
    got = jobs.drain(jobs.leases(jobs.stream(spark, folder, events)), str(tmp_path / "c3"), "lease").toPandas()
    held = got[got.state == "held"].groupby("job_id").events.max()
    assert set(held.index) == {r[0] for r in events.select("job_id").distinct().collect()}
    assert (got[got.state == "expired"].groupby("job_id").size() >= 1).all()
