"""Group bootstrap: confusion cells per group first, then replicate weights, never rows times replicates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.vectors import ratio
from quillstone.operators.metrics import CELLS, cells, class_scores, scored
from quillstone.staging import stage


def group_cells(df: DataFrame, by: str = "model") -> DataFrame:
    """(by, group_id, tn, fp, fn, tp); a null group is the body's own."""
    data = scored(df).withColumn("group_id", F.coalesce("group_id", "body_sha256"))
    return data.groupBy(by, "group_id").agg(*cells())


#: Draws that one SHA-256 gives, 32 bits each.
DRAWS = 8
_STEPS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)
#: Poisson(1) probabilities of at most 0, 1, ... as eight hexadecimal digits: a draw's digits are compared as text.
STEPS = tuple(f"{math.ceil(p * 2**32):08x}" for p in _STEPS)


def drawn(df: DataFrame, n: int, group: str = "group_id") -> DataFrame:
    """``df`` once for each of ``n`` replicates in which its group is drawn, with ``replicate`` and weight ``w``.

    The weight is Poisson(1), inverted at 32 bits of a hash of group and replicate, so all models share the draws; a hash serves
    ``DRAWS`` replicates.
    """
    spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism, group)  # few rows that become many
    hashed = spread.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // DRAWS)))).withColumn("__h", F.sha2(F.concat(F.col(group), F.lit(":"), F.col("__block").cast("string")), 256))
    each = hashed.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("replicate", F.col("__block") * DRAWS + F.col("__i")).where(F.col("replicate") < n)
    digits = F.substring(F.col("__h"), F.col("__i") * 8 + 1, F.lit(8))
    weighted = each.withColumn("__d", digits).where(F.col("__d") >= STEPS[0]).withColumn("w", sum(((F.col("__d") >= s).cast("int") for s in STEPS[1:]), F.lit(1)))
    return weighted.drop("__block", "__h", "__i", "__d")


def replicates(groups: DataFrame, n: int, by: str = "model", values: tuple[str, ...] = tuple(CELLS)) -> DataFrame:
    """(by, replicate, values summed) of ``n`` resamplings of groups. Groups with equal cells in all models are still drawn apart."""
    return drawn(groups, n).groupBy(by, "replicate").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in values])


def replicates_by_row(df: DataFrame, n: int, by: str = "model") -> DataFrame:
    """The same from rows, as a check of ``replicates``: every row carries its group's weight."""
    data = scored(df).withColumn("group_id", F.coalesce("group_id", "body_sha256")).select(by, "group_id", "truth", "guess")
    return drawn(data, n).groupBy(by, "replicate").agg(*[F.sum(F.when((F.col("truth") == t) & (F.col("guess") == g), F.col("w")).otherwise(0)).alias(c) for c, (t, g) in CELLS.items()])


def study_cells(df: DataFrame, policies: tuple[str, ...], by: str = "model") -> DataFrame:
    """``group_cells`` with, for each policy of the map ``discard``, how many rows it discards and how many of these need review."""
    data = scored(df).withColumn("group_id", F.coalesce("group_id", "body_sha256"))
    gone = lambda q: F.coalesce(F.try_element_at("discard", F.lit(q)), F.lit(False))
    counts = [c for i, q in enumerate(policies) for c in (F.count_if(gone(q)).alias(f"gone_{i}"), F.count_if(gone(q) & (F.col("truth") == 1)).alias(f"lost_{i}"))]
    return data.groupBy(by, "group_id").agg(*cells(), *counts)


def study_metrics(reps: DataFrame, policies: tuple[str, ...], by: str = "model") -> DataFrame:
    """(by, replicate, metric, value) of every metric that the study gives intervals for; a miss rate without support is null."""
    s = class_scores(reps)
    rows, support, skipped = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), F.col("fn") + F.col("tp"), F.col("tn") + F.col("fn")
    named = {
        "macro_f1": F.col("macro_f1"), "dangerous_miss_rate": ratio(F.col("fn"), support), "review_precision": F.col("review_precision"), "review_recall": F.col("review_recall"),
        "review_workload": ratio(rows - skipped, rows), "skip_fraction": ratio(skipped, rows),
    }
    for i, q in enumerate(policies):
        named |= {f"workload_{q}": ratio(F.col(f"gone_{i}"), rows), f"dangerous_miss_rate_{q}": ratio(F.col(f"lost_{i}"), support)}
    return s.select(by, "replicate", F.explode(F.create_map(*[x for k, v in named.items() for x in (F.lit(k), v.cast("double"))])).alias("metric", "value"))


def intervals(reps: DataFrame, metric: str = "macro_f1", by: str = "model") -> DataFrame:
    """The 2.5 and 97.5 % points by linear interpolation, and the mean."""
    return class_scores(reps).groupBy(by).agg(F.percentile(metric, F.lit(0.025)).alias("low"), F.avg(metric).alias("mean"), F.percentile(metric, F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("replicates"))


def intervals_of(values: DataFrame, by: str = "model") -> DataFrame:
    """(by, metric, low, high, valid_replicates) of (by, replicate, metric, value); values that are null or not finite don't count."""
    value = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    return values.groupBy(by, "metric").agg(F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"), F.count(value).alias("valid_replicates"))


def contrasts(reps: DataFrame, reference: str, metric: str = "macro_f1", by: str = "model") -> DataFrame:
    """Paired differences of every model to ``reference`` within replicates."""
    s = stage(class_scores(reps).select(by, "replicate", F.col(metric).alias("m"))).frame  # read twice
    base = s.where(F.col(by) == reference).select("replicate", F.col("m").alias("base"))
    d = s.where(F.col(by) != reference).join(base, "replicate").withColumn("delta", F.col("m") - F.col("base"))
    return d.groupBy(by).agg(F.percentile("delta", F.lit(0.025)).alias("low"), F.avg("delta").alias("mean"), F.percentile("delta", F.lit(0.975)).alias("high"))
