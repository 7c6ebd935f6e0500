"""Comparing recomputed results with given ones, within tolerances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t


def close(a: Column, b: Column, kind: t.DataType, rtol: float = 1e-9, atol: float = 1e-11) -> Column:
    """Whether two values agree: numbers within ``atol + rtol * |b|``, arrays and structs part by part, else exactly; nulls and NaNs equal themselves."""
    if isinstance(kind, (t.DoubleType, t.FloatType)):
        near = (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)) | (F.isnan(a) & F.isnan(b)) | (a == b)
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)
    if isinstance(kind, t.ArrayType):
        each = F.forall(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: close(p["x"], p["y"], kind.elementType, rtol, atol))
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise((F.size(a) == F.size(b)) & each)
    if isinstance(kind, t.StructType):
        same = F.lit(True)
        for f in kind.fields:
            same = same & close(a[f.name], b[f.name], f.dataType, rtol, atol)
        return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)
    return a.eqNullSafe(b)


def differences(actual: DataFrame, expected: DataFrame, keys: list[str], rtol: float = 1e-9, atol: float = 1e-11) -> DataFrame:
    """(keys, state, columns): rows that only one side has (``missing``, ``extra``), and those whose ``columns`` differ.

    Keys tell the rows of either side apart; null keys match each other.
    """
    values = [c for c in expected.columns if c not in keys]
    fields = {f.name: f.dataType for f in expected.schema.fields}
    x = actual.select(*[F.col(k).alias(f"x_{k}") for k in keys], F.struct(*values).alias("x"), F.lit(True).alias("has_x"))
    y = expected.select(*[F.col(k).alias(f"y_{k}") for k in keys], F.struct(*values).alias("y"), F.lit(True).alias("has_y"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"x_{k}").eqNullSafe(F.col(f"y_{k}"))
    both = x.join(y, same, "full")
    wrong = F.filter(F.array(*[F.when(~close(F.col("x")[c], F.col("y")[c], fields[c], rtol, atol), c) for c in values]), lambda c: c.isNotNull())
    state = F.when(F.col("has_x").isNull(), "missing").when(F.col("has_y").isNull(), "extra").when(F.size(wrong) > 0, "differs")
    named = [F.when(F.col("has_x").isNull(), F.col(f"y_{k}")).otherwise(F.col(f"x_{k}")).alias(k) for k in keys]
    columns = F.when(F.col("has_x") & F.col("has_y"), wrong).otherwise(F.array().cast("array<string>"))
    return both.select(*named, state.alias("state"), columns.alias("columns")).where("state is not null")
