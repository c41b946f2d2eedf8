"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..adapters import frame, with_frames
from ..sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Env:
    """Adapters and tables of one scale, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(values, schema)


def query(sql: str | None = None, name: str | None = None):
    """Registers ``f(env)``; ``sql`` may name adapters as tables."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Env(spark, sf_dir))
        if sql:
            ORACLES[key] = with_frames(sql)
        return f

    return register
