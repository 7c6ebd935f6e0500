"""Vectors and probabilities as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Probabilities at a temperature, shifted by the maximum so that nothing overflows."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / t))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def log_probabilities(p: Column, floor: float = 1e-12) -> Column:
    return F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(floor))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (the rule for rates)."""
    return a / F.nullif(b, F.lit(0))


def ratio0(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 (the rule for precision, recall and F1)."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
