"""Accounts under adaptive concurrency: tables against a plain version, the stream against the tables over a restart."""

import random

import pytest
from compare import rows

from lodeweave.streaming import pool

SCHEMA = "service string, account long, request long, sent_ms long, done_ms long, outcome string, delay_ms long"


def some(spark, seed, n=400, accounts=7):
    """Requests of a few busy accounts; many stand in flight when a level is cut, many end at one time."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        done = r.randrange(0, 900) * 5_000
        out.append((f"s{r.randrange(2)}", r.randrange(accounts) if r.random() < 0.6 else 0, i, done - r.randrange(0, 60) * 1000, done, r.choices(["ok", "throttled", "exhausted", "off", None], [70, 18, 9, 1, 1])[0], r.choice([None, 0, 20_000])))
    return out


def plain_levels(requests, start, most):
    """One account after another, request by request, with epochs as a pool in memory counts them."""
    accounts, out, done_of = {}, [], {}
    cuts = {}
    for service, account, request, sent, done, outcome, delay in sorted((q for q in requests if q[5]), key=lambda q: (q[4], q[2])):
        a = accounts.setdefault((service, account), {"level": start, "run": 0, "probing": True, "ready": 0, "off": False})
        times = cuts.setdefault((service, account), [])
        epoch_then = sum(t < sent for t in times)  # the cuts that a request knew of when it was sent
        if outcome == "off":
            a["off"] = True
        else:
            if outcome == "throttled":
                a["run"], a["probing"] = 0, False
                if epoch_then == len(times) and a["level"] > 1:
                    a["level"] -= 1
                    times.append(done)
            elif outcome == "ok":
                a["run"] += 1
                if a["level"] < most and a["run"] >= (a["level"] if a["probing"] else 4 * a["level"]):
                    a["level"], a["run"] = a["level"] + 1, 0
            if delay:
                a["ready"] = max(a["ready"], done + delay)
        out.append((service, account, request, done, a["level"], a["probing"], a["ready"], a["off"]))
    return sorted(out)


def plain_rests(requests, rest):
    """Every request against every answer of its service."""
    out = []
    for service, account, request, sent, done, outcome, _ in requests:
        if outcome is None:
            continue
        before = [(q[4], q[5] == "ok") for q in requests if q[0] == service and q[5] in ("ok", "exhausted") and q[4] <= sent]
        last = max(before, default=(0, True))
        out.append((service, account, request, sent, not last[1] and sent < last[0] + rest))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_tables_equal_a_plain_pool(spark, seed):
    requests = some(spark, seed)
    df = spark.createDataFrame(requests, SCHEMA)
    assert sorted(map(tuple, pool.account_levels(df).collect())) == plain_levels(requests, 3, 8)
    assert {x[5] for x in plain_levels(requests, 3, 8)} == {True, False}
    assert sorted(map(tuple, pool.service_rests(df).collect())) == plain_rests(requests, pool.REST_MS)
    assert any(x[4] for x in plain_rests(requests, pool.REST_MS))


def test_requests_in_flight_cut_once(spark):
    burst = [("s", 1, i, 0, 1000 + i, "throttled", 0) for i in range(8)] + [("s", 1, 9, 2000, 3000, "throttled", 0)]
    got = pool.account_levels(spark.createDataFrame(burst, SCHEMA), start=5).collect()
    assert [r["level"] for r in sorted(got, key=lambda r: r["done_ms"])] == [4] * 8 + [3]


def test_odd_rows(spark):
    odd = [(None, 1, 1, 0, 1, "ok", 0), ("s", None, 2, 0, 1, "ok", 0), ("s", 1, 3, 0, None, "ok", 0), ("s", 1, 4, None, 7, "ok", None), ("s", 1, None, 1, 8, "odd", None)]
    df = spark.createDataFrame(odd, SCHEMA)
    assert sorted(r["done_ms"] for r in pool.account_levels(df).collect()) == [7, 8]
    assert pool.account_levels(df.limit(0)).collect() == [] == pool.service_rests(df.limit(0)).collect()
    twice = df.where("request = 4").unionByName(df.where("request = 4"))
    assert pool.account_levels(twice).count() == 2 == pool.service_rests(twice).count()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    requests = [q for q in some(spark, 5) if q[5] and q[4]]  # a watermark starts at 0
    requests.sort(key=lambda q: (q[4], q[2]))
    source, out, folder = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (requests[:250], requests[250:]):  # the second run finds what the first one left
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            stream = pool.account_stream(spark.readStream.schema(SCHEMA).parquet(source), late="1 second")
            q = stream.writeStream.format("parquet").option("checkpointLocation", folder).trigger(availableNow=True).start(out)
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(out)
    told = got.where("kind = 'answered'").drop("kind")
    # an account's ties at the edge of two runs keep their order, as both are in order
    assert rows(told.toPandas()) == rows(pool.account_levels(spark.createDataFrame(requests, SCHEMA)).toPandas())
    ready = got.where("kind = 'ready'").collect()
    assert ready and all(r["request"] is None and not r["off"] and r["done_ms"] == r["ready_ms"] for r in ready)
