"""Vectors packed as little-endian 32-bit floats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t


def pack_floats(vector: Column) -> Column:
    """The bytes of a vector; null stays null."""

    @F.arrow_udf(t.BinaryType())
    def pack(vectors: pa.Array) -> pa.Array:
        return pa.array([None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in vectors.to_pylist()], pa.binary())

    return pack(vector)


def unpack_floats(packed: Column) -> Column:
    """The floats behind the bytes; null stays null, and bytes that are no whole number of floats are an error."""

    @F.arrow_udf(t.ArrayType(t.FloatType()))
    def unpack(values: pa.Array) -> pa.Array:
        return pa.array([None if b is None else np.frombuffer(b, dtype="<f4").tolist() for b in values.to_pylist()], pa.list_(pa.float32()))

    return unpack(packed)
