"""Accounts of services that find the concurrency they bear, as tables and as a stream with timers.

``requests(service, account, request, sent_ms, done_ms, outcome, delay_ms)``
has one row per answered request; outcomes are ``ok``, ``throttled``, ``off``
(the account is refused for good) and ``exhausted`` (the service gave up on
it). Rows without service, account, done_ms or outcome count for nothing; a
null sent_ms is done_ms, a null delay none.

- An account probes: it climbs one level after as many successes in a row as
  its level, until its first throttle; then it takes four times as many.
- Requests in flight when a level is cut are throttled together; only one sent
  after the last cut cuts again.
- A delay rests the account, an exhausted answer rests the service for three
  minutes or up to its next success.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Successes a level takes after the first throttle, and how long a service rests.
CAUTIOUS, REST_MS = 4, 180_000
#: A rest never reaches beyond the next slice of time.
SLICE_MS = 3_600_000


class Account(NamedTuple):
    """What is known of an account after an answer."""

    level: int
    streak: int = 0
    probing: bool = True
    cut_ms: int = -(1 << 62)
    ready_ms: int = 0
    off: bool = False

    def after(self, sent_ms: int, done_ms: int, outcome: str, delay_ms: int, most: int) -> Account:
        if outcome == "off":
            return self._replace(off=True)
        now = self._replace(ready_ms=max(self.ready_ms, done_ms + delay_ms)) if delay_ms > 0 else self
        if outcome == "throttled":
            cut = sent_ms > self.cut_ms and self.level > 1
            return now._replace(streak=0, probing=False, level=self.level - cut, cut_ms=done_ms if cut else self.cut_ms)
        if outcome != "ok":
            return now
        climbs = self.level < most and self.streak + 1 >= self.level * (1 if self.probing else CAUTIOUS)
        return now._replace(level=self.level + 1, streak=0) if climbs else now._replace(streak=self.streak + 1)


def _answered(requests: DataFrame) -> DataFrame:
    rows = requests.where("service is not null and account is not null and done_ms is not null and outcome is not null")
    sent, delay = F.coalesce("sent_ms", "done_ms").alias("sent_ms"), F.coalesce("delay_ms", F.lit(0)).alias("delay_ms")
    return rows.select("service", "account", "request", sent, "done_ms", "outcome", delay)


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _fold(rows: pd.DataFrame, account: Account, most: int) -> tuple[list[Account], Account]:
    out = []
    for sent, done, outcome, delay in zip(*(rows[c].tolist() for c in ("sent_ms", "done_ms", "outcome", "delay_ms"))):
        account = account.after(sent, done, outcome, delay, most)
        out.append(account)
    return out, account


def _told(rows: pd.DataFrame, states: list[Account]) -> pd.DataFrame:
    return rows[["service", "account", "request", "done_ms"]].assign(level=[s.level for s in states], probing=[s.probing for s in states], ready_ms=[s.ready_ms for s in states], off=[s.off for s in states])


_TOLD = "service {service}, account {account}, request {request}, done_ms long, level int, probing boolean, ready_ms long, off boolean"


def account_levels(requests: DataFrame, start: int = 3, most: int = 8) -> DataFrame:
    """Each answer in order of ``done_ms`` (ties by request) with its account's state after it.

    Accounts are dealt out and sorted, then streamed, so a task holds one
    account's state and one batch, however many requests an account has.
    """
    rows = _answered(requests)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, account = None, Account(start)
        for pdf in batches:
            parts = []
            # rows of one account are neighbours
            for _, part in pdf.groupby((pdf[["service", "account"]] != pdf[["service", "account"]].shift()).any(axis=1).cumsum(), sort=False):
                now = (part["service"].iloc[0], part["account"].iloc[0])
                if now != key:
                    key, account = now, Account(start)
                states, account = _fold(part, account, most)
                parts.append(_told(part, states))
            if parts:
                yield pd.concat(parts)

    told = _TOLD.format(**{c: _type(rows, c) for c in ("service", "account", "request")})
    return rows.repartition("service", "account").sortWithinPartitions("service", "account", "done_ms", "request").mapInPandas(run, told)


def service_rests(requests: DataFrame, rest_ms: int = REST_MS) -> DataFrame:
    """``(service, account, request, sent_ms, resting)``: whether the service rested when a request was sent.

    A rest holds from an exhausted answer until ``rest_ms`` later or the next
    success; of answers at one time a success counts last, and an answer at
    the time of sending counts. Time is cut into slices, with the last signal
    of each slice carried into the next, so a much used service is many groups.
    """
    rows = _answered(requests)
    slice_ms = max(SLICE_MS, rest_ms)
    slot = lambda at: F.floor(F.col(at) / slice_ms)
    signal = F.when(F.col("outcome") == "exhausted", 0).otherwise(1).alias("good")
    ended = rows.where("outcome in ('ok', 'exhausted')").select("service", F.col("done_ms").alias("at"), signal, slot("done_ms").alias("slot"))
    last = ended.groupBy("service", "slot").agg(F.max(F.struct("at", "good")).alias("m"))
    carried = last.select("service", "m.at", "m.good", (F.col("slot") + 1).alias("slot"))
    signals = ended.unionByName(carried).select("service", "slot", "at", F.struct("at", "good").alias("signal"), F.col("good").alias("turn"))
    asked = rows.select("service", slot("sent_ms").alias("slot"), F.col("sent_ms").alias("at"), F.lit(2).alias("turn"), F.struct("account", "request").alias("asks"))
    by = Window.partitionBy("service", "slot").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    seen = signals.unionByName(asked, allowMissingColumns=True).withColumn("before", F.last("signal", True).over(by)).where("asks is not null")
    resting = (F.col("before.good") == 0) & (F.col("at") < F.col("before.at") + rest_ms)
    return seen.select("service", "asks.account", "asks.request", F.col("at").alias("sent_ms"), F.coalesce(resting, F.lit(False)).alias("resting"))


class _Accounts(StatefulProcessor):
    """State and timers of one account."""

    def __init__(self, start: int, most: int):
        self.start, self.most = start, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("account", "level int, streak int, probing boolean, cut_ms long, ready_ms long, off boolean")

    def handleInputRows(self, key, rows, timerValues):
        account = Account(*self.state.get()) if self.state.exists() else Account(self.start)
        waited = account.ready_ms
        pdf = pd.concat(list(rows)).sort_values(["done_ms", "request"], kind="stable")
        states, account = _fold(pdf, account, self.most)
        self.state.update(tuple(account))
        if account.ready_ms > waited:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            # an event-time timer must lie ahead of the watermark
            self.handle.registerTimer(max(account.ready_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield _told(pdf, states).assign(kind="answered")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        account = Account(*self.state.get())
        if not account.off:
            row = pd.DataFrame({"service": [key[0]], "account": [key[1]], "request": pd.array([None], "Int64"), "done_ms": [account.ready_ms]})
            yield _told(row, [account]).assign(kind="ready")

    def close(self) -> None:
        pass


def account_stream(requests: DataFrame, start: int = 3, most: int = 8, late: str = "10 minutes") -> DataFrame:
    """:func:`account_levels` as a stream that outlives restarts, plus a ``ready`` row when an account's rest is over.

    A trigger's answers of one account are sorted in memory (limit a trigger by
    the source's ``maxFilesPerTrigger``); an answer that comes after later ones
    counts when it comes, one later than ``late`` never. The request's type is long. Needs the RocksDB state
    store: ``spark.sql.streaming.stateStore.providerClass``.
    """
    rows = _answered(requests).withColumn("request", F.col("request").cast("long")).withColumn("at", F.timestamp_millis("done_ms")).withWatermark("at", late)
    told = _TOLD.format(**{c: _type(rows, c) for c in ("service", "account", "request")}) + ", kind string"
    return rows.groupBy("service", "account").transformWithStateInPandas(_Accounts(start, most), told, "Append", "EventTime")
