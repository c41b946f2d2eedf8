"""Bundles: Parquet tables with a manifest, written aside and moved into place; OCR archives as blocks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "array<struct<type:string,page:int,bbox:array<double>,text:string,width:double,height:double>>"


def write_bundle(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Writes every table below ``path`` with a manifest of its rows; a reader sees all of it or nothing.

    Counts are observed while writing, so no table is read twice.
    """
    from pyspark.sql import Observation

    spark = next(iter(tables.values())).sparkSession
    aside, counts = f"{path.rstrip('/')}.{uuid.uuid4().hex}", {}
    for name, df in tables.items():
        seen = Observation(f"bundle {name}")
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{aside}/{name}")
        counts[name] = seen.get["rows"]
    spark.createDataFrame([(json.dumps(counts, sort_keys=True),)], "value string").coalesce(1).write.text(f"{aside}/manifest")
    at = spark._jvm.org.apache.hadoop.fs.Path(aside)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).rename(at, spark._jvm.org.apache.hadoop.fs.Path(path)):
        raise OSError(f"{path} could not be put in place")
    return counts


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    counts = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in counts}


def drop_bundle(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def ocr_blocks(archives: DataFrame, content: str = "content") -> DataFrame:
    """Blocks of OCR archives (a JSON array a document) in order, coordinates scaled to 0..1000 of their page; malformed archives give none."""
    blocks = archives.select("doc_id", F.posexplode(F.from_json(content, BLOCK)).alias("seq", "b"))
    box = F.array(*[F.round(F.get("b.bbox", i) * 1000 / F.col("b.width" if i % 2 == 0 else "b.height"), 1) for i in range(4)])
    return blocks.select("doc_id", "seq", F.col("b.type").alias("type"), F.col("b.page").alias("page"), box.alias("bbox"), F.col("b.text").alias("text"))


def ocr_tables(archives: DataFrame, content: str = "content") -> DataFrame:
    return ocr_blocks(archives, content).where("type = 'table'")
