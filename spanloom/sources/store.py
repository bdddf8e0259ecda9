"""Stored tables: records are keyed once, then every query reads the keyed table.

Tables go to the folder that the cluster names in ``spark.checkpoint.dir``; only
in local mode, where it is unset, to a temporary folder of our own.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_BUILT: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _files(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of every file below a path, in any store that Spark reads."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, each = [], system.listFiles(root, True)
    while each.hasNext():
        f = each.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def built_once(spark: SparkSession, path: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes from the files at ``path``; stored at first, read from then on.

    It is made anew where the files have changed or the session is another.
    """
    key = (spark.sparkContext.applicationId, name, _files(spark, path))
    if key not in _BUILT:
        at = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(at)
        _BUILT[key] = at
    return spark.read.parquet(_BUILT[key])


def written(df: DataFrame, name: str, use: Callable[[DataFrame], T]) -> T:
    """What ``use`` makes of ``df``, which is made once and stored until then however often it is read."""
    spark = df.sparkSession
    at = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = use(spark.read.parquet(at))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return out


def upsert(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    """Set keys of a small (key, value) table; other keys stay. Its size is that of the keys ever set."""
    from pyspark.errors import AnalysisException

    try:
        before = {r["key"]: r["value"] for r in spark.read.json(path, schema="key string, value string").collect()}
    except AnalysisException:
        before = {}
    rows = sorted({**before, **{k: str(v) for k, v in values.items()}}.items())
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").json(path)


def in_batches(df: DataFrame, key: str, path: str, batches: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` over ``batches`` parts of ``df``, dealt by a hash of ``key``, each written below ``path``.

    A part whose folder is complete is not done again, so a run that was cut
    off goes on where it stopped.
    """
    from pyspark.sql import functions as F

    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for k in range(batches):
        at = f"{path}/part={k}"
        done = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            work(df.where(F.pmod(F.xxhash64(key), F.lit(batches)) == k)).write.mode("overwrite").parquet(at)
    return spark.read.parquet(path).drop("part")
