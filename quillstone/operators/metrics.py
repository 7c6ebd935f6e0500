"""Quality of a two-class router from one pass of conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.vectors import ratio, ratio0

POSITIVE, NEGATIVE = "review_worthy", "routine"
BINS = 10


def prediction(p1: Column) -> Column:
    """An exact tie goes to review."""
    return F.when(p1 >= 0.5, POSITIVE).otherwise(NEGATIVE)


def scored(df: DataFrame) -> DataFrame:
    """Adds p0, p1, truth (1 for review), guess, confidence, from ``probabilities`` and ``reference``."""
    p0, p1 = F.col("probabilities")[0], F.col("probabilities")[1]
    return df.withColumns({"p0": p0, "p1": p1, "truth": (F.col("reference") == POSITIVE).cast("int"), "guess": (p1 >= 0.5).cast("int"), "confidence": F.greatest(p0, p1)})


def _cell(truth: int, guess: int) -> Column:
    return F.count_if((F.col("truth") == truth) & (F.col("guess") == guess))


CELLS = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}


def cells() -> list[Column]:
    return [_cell(*v).alias(k) for k, v in CELLS.items()]


def class_scores(c: DataFrame) -> DataFrame:
    """precision, recall and F1 of both classes, macro F1 and accuracy, from tn, fp, fn and tp; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(x) for x in CELLS)
    return c.withColumns({
        "routine_precision": ratio0(tn, tn + fn), "routine_recall": ratio0(tn, tn + fp), "routine_f1": ratio0(2 * tn, 2 * tn + fp + fn),
        "review_precision": ratio0(tp, tp + fp), "review_recall": ratio0(tp, tp + fn), "review_f1": ratio0(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio(tn + tp, tn + fp + fn + tp),
    }).withColumn("macro_f1", (F.col("routine_f1") + F.col("review_f1")) / 2)


def brier() -> Column:
    """Mean over rows of the squared errors of both columns."""
    return F.avg(F.pow(F.col("p0") - (1 - F.col("truth")), F.lit(2)) + F.pow(F.col("p1") - F.col("truth"), F.lit(2)))


def log_loss(floor: float = 1e-12) -> Column:
    return F.avg(-F.ln(F.greatest(F.when(F.col("truth") == 1, F.col("p1")).otherwise(F.col("p0")), F.lit(floor))))


def breakdown(df: DataFrame, slices: list[str], by: str = "model") -> DataFrame:
    """Scores overall and by each of ``slices``, per ``by``, by grouping sets: one scan, one shuffle."""
    data = scored(df)
    columns = [F.col(s) for s in slices]
    grouped = data.groupingSets([[F.col(by)], *[[F.col(by), c] for c in columns]], F.col(by), *columns).agg(F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("rows"), *cells(), brier().alias("brier"), log_loss().alias("log_loss"))
    width = len(slices)  # the bit of a column that a row is grouped by is 0
    name, value = F.lit("overall"), F.lit(None).cast("string")
    for i, s in enumerate(slices):
        mine = F.col("__set") == (2**width - 1) ^ (1 << (width - 1 - i))
        name, value = F.when(mine, s).otherwise(name), F.when(mine, F.col(s).cast("string")).otherwise(value)
    return class_scores(grouped.withColumns({"slice": name, "slice_value": value}).drop("__set", *slices))


def bins(df: DataFrame, by: str = "model") -> DataFrame:
    """The reliability table: all bins of the confidence, half-open, the last closed; accuracy null where a bin is empty."""
    spark = df.sparkSession
    data = scored(df).withColumn("bin", F.least(F.floor(F.col("confidence") * BINS), F.lit(BINS - 1)).cast("int"))
    found = data.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("confidence"), F.avg((F.col("truth") == F.col("guess")).cast("int")).alias("accuracy"))
    every = df.select(by).distinct().join(F.broadcast(spark.range(BINS).select(F.col("id").cast("int").alias("bin"))))
    return every.join(found, [by, "bin"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def calibration_error(b: DataFrame, by: str = "model") -> DataFrame:
    """Expected calibration error from the reliability table."""
    return b.groupBy(by).agg(ratio(F.sum(F.col("rows") * F.abs(F.col("accuracy") - F.col("confidence"))), F.sum("rows")).alias("ece"))


def policy_scores(flags: DataFrame, by: list[str]) -> DataFrame:
    """What a skip rule costs: ``flags`` has truth and skipped; rates are null where nothing is counted."""
    miss = F.count_if((F.col("truth") == 1) & F.col("skipped"))
    n, skipped, support = F.count(F.lit(1)), F.count_if("skipped"), F.sum("truth")
    return flags.groupBy(*by).agg(
        n.alias("rows"), skipped.alias("discarded"), ratio(skipped, n).alias("workload_reduction"), support.alias("review_worthy_support"), miss.alias("dangerous_misses"),
        ratio(miss, support).alias("dangerous_miss_rate"), ratio(miss, skipped).alias("discard_contamination"), (n - skipped).alias("reviewed"), ratio(n - skipped, n).alias("review_workload"),
    )
