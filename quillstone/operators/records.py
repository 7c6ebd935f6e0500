"""Filing records: defaults, identity, families, periods, annotations, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Last days of the training, validation and test periods.
CUTOFFS = ("2026-03-31", "2026-06-30", "2026-09-30")
LABELS = ("routine", "review_worthy")


def with_defaults(df: DataFrame) -> DataFrame:
    """Adds src, kind, event, body_sha256: defaults and spelling settled. Other columns stay; null bodies have no hash."""
    event = F.lower(F.regexp_replace("event_id", r"[\s-]+", ""))
    return df.withColumns({
        "src": F.coalesce(F.lower(F.trim("source")), F.lit("sec")), "kind": F.coalesce(F.lower(F.trim("document_type")), F.lit("8-k")),
        "event": F.when(event.contains(":") & (event != "sec:unknown"), event), "body_sha256": F.sha2("body", 256),
    })


def family(src: Column, kind: Column) -> Column:
    """The cohort family of a source and document type; a regulatory filing of unknown type is ``other``."""
    regulatory = F.when(kind == "8-k", "8k").when(kind == "6-k", "6k").when(kind == "corporate_release", "releases").otherwise("other")
    return F.when(src == "sec", regulatory).when(kind == "news", "news").otherwise(src)


def period(day: Column, cutoffs: tuple[str, str, str] = CUTOFFS) -> Column:
    """train, validation, test or outside, by inclusive last days; null days are outside."""
    return F.when(day <= cutoffs[0], "train").when(day <= cutoffs[1], "validation").when(day <= cutoffs[2], "test").otherwise("outside")


def effective(human: Column, llm: Column) -> Column:
    """The whole human annotation where it has a label, else the whole machine one."""
    return F.when(human["label"].isNotNull(), human).otherwise(llm)


def first_reason(*reasons: tuple[str, Column], default: str = "accepted") -> Column:
    """The name of the first condition that holds (null counts as not)."""
    out = F
    for name, condition in reasons:
        out = out.when(F.coalesce(condition, F.lit(False)), name)
    return out.otherwise(default)


def first_wins(df: DataFrame, key: str, order: list[Column | str], last: bool = False) -> DataFrame:
    """One row per ``key``: the first (or last) in ``order``, which must tell rows apart; null keys are one key.

    Found by aggregation, so copies of one key are folded before the shuffle and a hot key costs nothing.
    """
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    row = F.struct(*df.columns)
    return df.groupBy(key).agg((F.max_by if last else F.min_by)(row, rank).alias("__row")).select("__row.*")


def crossing(df: DataFrame, key: str, span: str) -> DataFrame:
    """Keys whose rows lie in more than one value of ``span``, with the smallest, the largest and the number; null keys never do."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(span).alias("spans"), F.min(span).alias("first_span"), F.max(span).alias("last_span"), F.count(F.lit(1)).alias("rows")).where("spans > 1")


def blocked_by(candidates: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates without a match in ``base`` on any of ``keys``; a null key never matches."""
    out = candidates
    for k in keys:
        out = out.join(base.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return out.select(*candidates.columns)


def edges_to_first(df: DataFrame, key: str, node: str) -> DataFrame:
    """An edge from every node to the smallest one with the same key, loops left out."""
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(node).alias("root"))
    return df.join(least, key).where(F.col(node) != F.col("root")).select(F.col(node).alias("a"), F.col("root").alias("b")).distinct()


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("distinct_values"), F.min(value).alias("least"), F.max(value).alias("greatest")).where("distinct_values > 1")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each composite ``key`` in ``order``."""
    row = F.struct(*df.columns)
    return df.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("__row")).select("__row.*")
