"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_TABLES: list[str] = []


def staging_root(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``; a local one only where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        _ROOTS[app] = f"{base.rstrip('/')}/quillstone-{app}"
        atexit.register(_end, spark, _ROOTS[app])
    return _ROOTS[app]


def _end(spark: SparkSession, path: str) -> None:
    try:
        while _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    except Exception:  # the session may be gone when the interpreter ends
        pass
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


class Stage:
    """A written intermediate table; ``drop()`` removes its files once nothing reads it any more."""

    def __init__(self, frame: DataFrame, path: str):
        self.frame, self.path = frame, path

    def drop(self) -> None:
        _remove(self.frame.sparkSession, self.path)


def stage(df: DataFrame) -> Stage:
    """Write ``df`` once and read it back: lineage is cut, and the loss of an executor costs nothing."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return Stage(spark.read.schema(df.schema).parquet(path), path)


class Buckets(Stage):
    """A table in buckets of a key and in parts, to which parts can be added; read parts keep the buckets."""

    def __init__(self, df: DataFrame, key: str, part: str | None = None):
        spark = df.sparkSession
        self.name, self.key, self.part = f"quillstone_{uuid.uuid4().hex}", key, part
        self.buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.path = f"{staging_root(spark)}/{self.name}"
        _TABLES.append(self.name)
        self.add(df)

    def add(self, df: DataFrame) -> None:
        writer = df.write.option("compression", "zstd").option("path", self.path).bucketBy(self.buckets, self.key).sortBy(self.key).mode("append")
        (writer.partitionBy(self.part) if self.part else writer).saveAsTable(self.name)
        self.frame = df.sparkSession.table(self.name)


def stage_bucketed(df: DataFrame, key: str) -> Stage:
    """Write ``df`` in as many buckets of ``key`` as there are shuffle partitions: joins and groups by it need no shuffle."""
    return Buckets(df, key)


def cut(df: DataFrame) -> DataFrame:
    """``stage`` for tables that live as long as the session."""
    return stage(df).frame
