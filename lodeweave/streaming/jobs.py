"""Leased jobs as streams: deadlines, leases, presence, reuse of waiting work.

Event time drives all rules, so a replay gives the same result. Windows over
the events are additions of Spark's kind, not reference operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUEUE_LIMIT, RUN_LIMIT, LEASE = "30 minutes", "4 minutes", "30 minutes"


def stream(spark: SparkSession, path: str, like: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream over a folder of Parquet files with a watermark; ``ts`` without a zone is taken as UTC."""
    return spark.readStream.schema(like.schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def overdue(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs that fail because they waited or ran beyond their limits at ``now``."""
    at = F.lit(now).cast("timestamp")
    since = F.when(F.col("status") == "queued", F.col("created_at") + F.expr(f"interval {QUEUE_LIMIT}")).when(F.col("status") == "running", F.col("claimed_at") + F.expr(f"interval {RUN_LIMIT}"))
    return jobs.withColumn("deadline", since).where(F.col("deadline") <= at)


def expired(leases: DataFrame, now: str) -> DataFrame:
    """Leases that end at or before ``now``: their work returns to the pool."""
    return leases.where(F.col("claimed_at") + F.expr(f"interval {LEASE}") <= F.lit(now).cast("timestamp"))


def claim(jobs: DataFrame, agent: str, now: str, n: int) -> DataFrame:
    """The first ``n`` open jobs by age, of which those leased by others are then skipped, so fewer may be claimed."""
    first = jobs.where("status in ('queued', 'leased')").orderBy("created_at", "job_id").limit(n)
    free = (F.col("status") == "queued") | (F.col("agent") == agent) | (F.col("claimed_at") + F.expr(f"interval {LEASE}") <= F.lit(now).cast("timestamp"))
    return first.where(free).select("job_id", F.lit(agent).alias("agent"), (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"))


def recovered(jobs: DataFrame, now: str, executor: str = "api") -> DataFrame:
    """Jobs as a worker finds them when it starts: what is overdue failed, what an ``executor`` worker left running waits again."""
    late = overdue(jobs.where(F.col("executor") == executor), now).select("job_id", F.lit(True).alias("late"))
    status = F.when(F.col("late"), "failed").when((F.col("executor") == executor) & (F.col("status") == "running"), "queued").otherwise(F.col("status"))
    return jobs.join(late, "job_id", "left").withColumn("status", status).drop("late")


def lease_times(jobs: DataFrame, now: str) -> DataFrame:
    """Adds ``lease_ends``, ``lease_left`` in seconds (0 once it ended) and ``fails_at``, the limit of the job's state."""
    ends = F.col("claimed_at") + F.expr(f"interval {LEASE}")
    left = F.greatest(F.lit(0), F.unix_timestamp(ends) - F.unix_timestamp(F.lit(now).cast("timestamp")))
    fails = F.when(F.col("status") == "queued", F.col("created_at") + F.expr(f"interval {QUEUE_LIMIT}")).when(F.col("status") == "running", F.col("claimed_at") + F.expr(f"interval {RUN_LIMIT}"))
    return jobs.withColumns({"lease_ends": ends, "lease_left": left, "fails_at": fails})


def hedged(calls: DataFrame, after: float = 18.0) -> DataFrame:
    """Answers of calls that get a duplicate when they straggle: adds ``hedged``, ``answered_by`` and ``seconds``.

    ``calls(first_s, first_ok, second_s, second_ok, spare)`` have the time of
    each request since it was sent, whether it succeeds, and whether a slot was
    free for the duplicate, which is sent ``after`` seconds if the first is
    still out (0: never). The earlier success answers, of two at once the
    first; ``answered_by`` is null where none succeeds, ``seconds`` then the
    later end.
    """
    sent = (F.lit(after) > 0) & (F.col("first_s") > after) & F.col("spare")
    second_end = F.when(sent, F.col("second_s") + after)
    good = lambda end, ok: F.when(F.col(ok), end)
    one, two = good(F.col("first_s"), "first_ok"), good(second_end, "second_ok")
    by = F.when(one.isNotNull() & (two.isNull() | (one <= two)), "first").when(two.isNotNull(), "second")
    return calls.withColumns({"hedged": sent, "answered_by": by, "seconds": F.coalesce(F.least(one, two), F.greatest(F.col("first_s"), second_end))})


def reuse(requests: DataFrame) -> DataFrame:
    """Of identical requests within the watermark only the first makes a job."""
    return requests.dropDuplicatesWithinWatermark(["job_id", "kind"]) if requests.isStreaming else requests.dropDuplicates(["job_id", "kind"])


def presence(heartbeats: DataFrame, key: str = "job_id") -> DataFrame:
    """Latest state of each key."""
    return heartbeats.groupBy(key).agg(F.max(F.struct("ts", "event_id", "kind")).alias("l")).select(key, F.col("l.ts").alias("ts"), F.col("l.kind").alias("kind"))


def stale_results(results: DataFrame, current: DataFrame) -> DataFrame:
    """Results with whether the version they were made for is still the current one (a stream-static join)."""
    return results.join(current, "question_id", "left").withColumn("accepted", F.coalesce(F.col("made_for") == F.col("hash"), F.lit(False)))


def leases(events: DataFrame) -> DataFrame:
    """Stateful leases: each event holds its job's lease; one that is not renewed in time gives an ``expired`` row."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, count = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "state": ["expired"], "events": [count], "at_ms": [last + 1_800_000]})
            return
        last, count = state.get if state.exists else (0, 0)
        for pdf in batches:
            ms = (pdf["ts"].astype("int64") // (1_000_000 if pdf["ts"].dtype == "datetime64[ns]" else 1_000)).max() if len(pdf) else 0
            last, count = max(last, int(ms)), count + len(pdf)
        state.update((last, count))
        state.setTimeoutTimestamp(max(last + 1_800_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "state": ["held"], "events": [count], "at_ms": [last]})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, state string, events long, at_ms long", "last long, count long", "append", GroupStateTimeout.EventTimeTimeout)


def _next_level(state: tuple[int, int, bool], outcome: str, least: int = 1, most: int = 8, good: int = 5) -> tuple[int, int, bool]:
    """Level, run of successes and whether this epoch has slowed down already, after one more outcome."""
    level, run, cooled = state
    if outcome == "throttled":
        return (level if cooled else max(least, level - 1)), 0, True
    if run + 1 == good:
        return min(most, level + 1), 0, False
    return level, run + 1, cooled


def throttle(outcomes: list[str], start: int, **bounds) -> list[int]:
    """Concurrency after each outcome: one less on a throttle (once an epoch), one more after a run of successes."""
    out, state = [], (start, 0, False)
    for outcome in outcomes:
        state = _next_level(state, outcome, **bounds)
        out.append(state[0])
    return out


def throttled(outcomes: DataFrame, start: int, **bounds) -> DataFrame:
    """``(pool, step, level)`` for ``outcomes(pool, step, outcome)``, each pool with a level of its own.

    Outcomes stream in order; a task holds one pool's state, whatever the pool's length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, state = object(), (start, 0, False)
        for rows in batches:
            levels = []
            for now, outcome in zip(rows["pool"].tolist(), rows["outcome"].tolist()):
                if now != pool:
                    pool, state = now, (start, 0, False)
                state = _next_level(state, outcome, **bounds)
                levels.append(state[0])
            yield rows[["pool", "step"]].assign(level=levels)

    rows = outcomes.select("pool", "step", "outcome").where("pool is not null")
    kinds = dict(rows.dtypes)
    return rows.repartition("pool").sortWithinPartitions("pool", "step").mapInPandas(run, f"pool {kinds['pool']}, step {kinds['step']}, level int")


def counts_by_window(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Tumbling counts by type (an addition)."""
    return events.groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "kind", "events", "value")


def drain(df: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote to a memory table."""
    spark = df.sparkSession
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
