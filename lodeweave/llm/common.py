"""Shared helpers of the training-data operators.

Intermediate tables are written to the folder that ``spark.checkpoint.dir``
names and read back, so that lineage is cut by files every executor can see
and a lost executor costs a rerun of tasks only.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Folders of the applications of this process, and the tables cut in them that are not deleted yet.
_folders: dict[str, str] = {}
_cuts: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode a temporary one where none is named.

    The setting is read only: Spark takes it when the application starts and refuses changes.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("start the application with spark.checkpoint.dir naming a folder that the driver and all executors share")
    if context.applicationId not in _folders:
        _folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodeweave-")
    return _folders[context.applicationId]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again; what is not dropped goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _cuts[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(path: str) -> None:
    spark = _cuts.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop_cut(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`cut` that are read no more."""
    for df in tables:
        if path := getattr(df, "_cut_path", None):
            _delete(path)


@contextlib.contextmanager
def scratch(*keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Drops, on leaving, all tables cut inside but those put on the list that it yields."""
    before, kept = set(_cuts), list(keep)
    yield kept
    stay = {getattr(df, "_cut_path", None) for df in kept}
    for path in set(_cuts) - before - stay:
        _delete(path)


@atexit.register
def _drop_all() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        for path in list(_cuts):
            _delete(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` would change other letters too."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but those that a result replaces."""
    return [c for c in df.columns if c.lower() not in names]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns, none of which ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def whole(text: str | Column = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
