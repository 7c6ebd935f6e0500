"""Global and per-bucket order without sending a bucket to one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from quillstone.staging import stage


def with_ordinal(df: DataFrame, order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """``df`` with its rows' positions (from 1) in the total order ``order``, which must tell all rows apart.

    Rows are range-partitioned and sorted, numbered within partitions while they stream, and shifted by the sizes of the
    partitions before theirs (a table with a row per partition).
    """
    schema = df.schema
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    local = _numbered(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            yield b.append_column("__at", pa.array(np.arange(at + 1, at + 1 + b.num_rows, dtype=np.int64)))
            at += b.num_rows

    numbered = stage(ranged.mapInArrow(number, local)).frame
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    shift = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("shift"))
    return numbered.join(F.broadcast(shift), "__part").select(*df.columns, (F.col("__at") + F.col("shift")).alias(name))


def _numbered(schema: t.StructType) -> t.StructType:
    return t.StructType([*schema.fields, t.StructField("__part", t.IntegerType()), t.StructField("__at", t.LongType())])


def running_totals(df: DataFrame, bucket: str, order: list[Column], values: list[str]) -> DataFrame:
    """``df`` with ``<value>_upto`` for each of the long columns ``values``: their sums over the bucket's rows up to this one.

    ``order`` must tell a bucket's rows apart. As in ``with_ordinal``, a bucket may span any number of partitions: these add up their own
    rows as they stream, and what lies before them comes from a table with a row per partition and bucket it touches.
    """
    schema = t.StructType([*df.schema.fields, t.StructField("__part", t.IntegerType()), *[t.StructField(f"__{v}", t.LongType()) for v in values]])
    ranged = df.repartitionByRange(F.col(bucket), *order).sortWithinPartitions(F.col(bucket), *order).withColumn("__part", F.spark_partition_id())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            keys = b[bucket].to_pylist()
            starts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
            for v in values:
                x = np.asarray(b[v].to_numpy(zero_copy_only=False), dtype=np.int64)
                out = np.empty(len(x), np.int64)
                for s, e in zip(starts, [*starts[1:], len(keys)]):
                    before = held.get(v, (None, 0))
                    out[s:e] = np.cumsum(x[s:e]) + (before[1] if before[0] == (keys[s],) else 0)
                    held[v] = (keys[s],), int(out[e - 1])
                b = b.append_column(f"__{v}", pa.array(out))
            yield b

    summed = stage(ranged.mapInArrow(add_up, schema)).frame
    parts = summed.groupBy("__part", F.col(bucket).alias("__bucket")).agg(*[F.sum(v).alias(v) for v in values])
    w = Window.partitionBy("__bucket").orderBy("__part")
    before = parts.select(F.col("__part").alias("__p"), "__bucket", *[(F.sum(v).over(w) - F.col(v)).alias(f"__before_{v}") for v in values])
    joined = summed.join(before, (F.col("__part") == F.col("__p")) & F.col(bucket).eqNullSafe(F.col("__bucket")))
    return joined.select(*df.columns, *[(F.col(f"__{v}") + F.col(f"__before_{v}")).alias(f"{v}_upto") for v in values])


def rank_in_bucket(df: DataFrame, bucket: str, order: list[str], name: str = "rn") -> DataFrame:
    """Positions (from 1) within each value of ``bucket``, by ``order``; any bucket may hold most rows."""
    placed = with_ordinal(df, [bucket, *order], "__ordinal")
    first = placed.groupBy(F.col(bucket).alias("__bucket")).agg((F.min("__ordinal") - 1).alias("__before"))
    return placed.join(first, F.col(bucket).eqNullSafe(F.col("__bucket"))).select(*df.columns, (F.col("__ordinal") - F.col("__before")).alias(name))


def round_robin(df: DataFrame, bucket: str, order: list[str], lead: list[Column] | None = None) -> DataFrame:
    """Interleave the buckets: every bucket's first row, then every second one, buckets by name; adds ``ordinal``.

    ``lead``: expressions that come before in the order, such as a class of buckets to exhaust first.
    """
    ranked = rank_in_bucket(df, bucket, order)
    for i, e in enumerate(lead or []):
        ranked = ranked.withColumn(f"__lead{i}", e)
    keys = [*[f"__lead{i}" for i in range(len(lead or []))], "rn", bucket]
    return with_ordinal(ranked, keys).drop(*[f"__lead{i}" for i in range(len(lead or []))])


def chunk_of(ordinal: Column, size: int) -> Column:
    """The chunk (from 0) of a position (from 1)."""
    return F.floor((ordinal - 1) / size).cast("long")


def ordered_digest(df: DataFrame, by: str, ordinal: str, text: Column, chunk: int = 4096) -> DataFrame:
    """A SHA-256 per ``by`` over ``text`` in the order of ``ordinal``: of the digests of its chunks, so no group is gathered whole."""
    rows = df.select(by, F.col(ordinal).alias("__o"), text.alias("__t")).withColumn("__c", chunk_of(F.col("__o"), chunk))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"]), "\n")
    parts = rows.groupBy(by, "__c").agg(F.sha2(joined(F.struct(F.col("__o").alias("o"), F.col("__t").alias("t"))), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(by).agg(F.sha2(joined(F.struct(F.col("__c").alias("o"), F.col("d").alias("t"))), 256).alias("digest"), F.sum("n").alias("rows"))
