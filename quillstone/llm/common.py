"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the project counts it (Unicode), for Java's regular expressions.
SPACE_CHARS = r"\s\x1c-\x1f\x85\xa0  -     　"
SPACE = f"[{SPACE_CHARS}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_of(column: str = "source") -> Column:
    """Lowercased and trimmed; null reads as ``sec``."""
    return F.coalesce(F.lower(F.trim(F.col(column))), F.lit("sec"))


def blank(column: str) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(~F.col(column).rlike(f"[^{SPACE_CHARS}]"), F.lit(True))
