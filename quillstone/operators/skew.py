"""Joins to a table of distinct keys when few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys are salted; a key is hot above a ``HOT_KEYS``-th of all rows, so there can't be more.
HOT_KEYS = 500
SALTS = 64


def skew_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, salts: int = SALTS) -> DataFrame:
    """Inner join of ``rows`` to ``keyed``, which has one row per ``key`` and how many ``rows`` hold it in ``count``.

    Keys with more than a ``HOT_KEYS``-th of all counted rows are spread over ``salts`` tasks: their row in
    ``keyed`` is repeated, theirs in ``rows`` get a salt by hash of the row (not at random, so a lost task can be run again). Their list (at most HOT_KEYS keys) is broadcast.
    Null keys join nothing.
    """
    total = keyed.agg(F.sum(count).alias("t"))
    hot = keyed.select(key, count).crossJoin(F.broadcast(total)).where((F.col(count) * HOT_KEYS > F.col("t")) & (F.col(count) > 10_000)).select(F.col(key).alias("__hot"))
    left = rows.join(F.broadcast(hot), rows[key] == F.col("__hot"), "left")
    left = left.withColumn("__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    right = keyed.join(F.broadcast(hot), keyed[key] == F.col("__hot"), "left")
    right = right.withColumn("__salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return left.join(right, [key, "__salt"]).drop("__salt")
