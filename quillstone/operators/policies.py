"""Skip thresholds and temperatures, fitted from value histograms rather than row windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.vectors import log_probabilities, softmax
from quillstone.operators.metrics import scored
from quillstone.operators.ordering import running_totals
from quillstone.staging import stage

NEVER = 1.000001
MISS_RATES = (0.01, 0.05)
SKIP_SHARES = (0.1, 0.2, 0.3)


def cut_points(df: DataFrame, by: str = "model") -> DataFrame:
    """Per distinct p0: how many rows and how many of them need review are skipped at that threshold; ties move together.

    Rows are folded to distinct values of p0 first, and these added up in order over any number of tasks.
    """
    steps = scored(df).where("p1 < 0.5").groupBy(by, "p0").agg(F.count(F.lit(1)).alias("skipped"), F.sum("truth").alias("missed"))
    return running_totals(steps, by, [F.desc("p0")], ["skipped", "missed"]).select(by, F.col("p0").alias("threshold"), F.col("skipped_upto").alias("skipped"), F.col("missed_upto").alias("missed"))


def fit_policies(df: DataFrame, by: str = "model") -> DataFrame:
    """(by, policy, threshold, skipped, missed): the most skipped under each miss rate or skip share, the highest threshold on ties."""
    totals = scored(df).groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.sum("truth").alias("support"))
    spark = df.sparkSession
    names = [(str(r), r, True) for r in MISS_RATES] + [(f"skip_{s}", s, False) for s in SKIP_SHARES]
    rules = spark.createDataFrame(names, "policy string, bound double, by_miss boolean")
    points = cut_points(df, by).unionByName(totals.select(by, F.lit(NEVER).alias("threshold"), F.lit(0).cast("long").alias("skipped"), F.lit(0).cast("long").alias("missed")))
    allowed = F.when(F.col("by_miss"), (F.col("support") > 0) & (F.col("missed") <= F.col("bound") * F.col("support"))).otherwise(F.col("skipped") <= F.floor(F.col("bound") * F.col("rows") + 1e-9)) | (F.col("threshold") == NEVER)
    fits = points.join(totals, by).join(F.broadcast(rules)).where(allowed)
    return fits.groupBy(by, "policy").agg(F.max_by(F.struct("threshold", "skipped", "missed"), F.struct("skipped", "threshold")).alias("x")).select(by, "policy", "x.*")


def skip(p0: Column, p1: Column, threshold: Column) -> Column:
    return (p1 < 0.5) & (p0 >= threshold)


def margins(df: DataFrame, by: str = "model") -> DataFrame:
    """(by, margin, count): distinct log odds of the true class, clipped at 1e-12; a grid multiplies these, not rows."""
    data = scored(df)
    z = F.ln(F.greatest("p1", F.lit(1e-12))) - F.ln(F.greatest("p0", F.lit(1e-12)))
    return data.select(by, F.when(F.col("truth") == 1, z).otherwise(-z).alias("margin")).groupBy(by, "margin").count()


def _losses(folded: DataFrame, grid: Column, by: str) -> DataFrame:
    """(by, log_t, nll): mean log(1 + exp(-margin / t)) at each log temperature."""
    m = F.col("margin") / F.exp("log_t")
    loss = F.greatest(-m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))
    spread = folded.repartition(folded.sparkSession.sparkContext.defaultParallelism, "margin").withColumn("log_t", F.explode(grid))
    return spread.groupBy(by, "log_t").agg((F.sum(F.col("count") * loss) / F.sum("count")).alias("nll"))


def grid_temperature(df: DataFrame, log_temperatures: list[float], by: str = "model") -> DataFrame:
    """(by, log_t, nll) over a grid of log temperatures: one aggregate."""
    return _losses(margins(df, by), F.array(*[F.lit(float(t)) for t in log_temperatures]), by)


def fit_temperature(df: DataFrame, by: str = "model", rounds: int = 4, width: int = 24) -> DataFrame:
    """(by, log_t, nll): the best log temperature in [-3, 3], refined ``rounds`` times around the best grid point; all groups at once."""
    step = 6.0 / width
    folded = stage(margins(df, by)).frame
    best = stage(_best(_losses(folded, F.array(*[F.lit(-3 + i * step) for i in range(width + 1)]), by), by)).frame
    for _ in range(rounds):
        span, step = step, 2 * step / width
        around = F.array(*[F.least(F.lit(3.0), F.greatest(F.lit(-3.0), F.col("centre") - span + i * step)) for i in range(width + 1)])
        tried = folded.join(F.broadcast(best.select(by, F.col("log_t").alias("centre"))), by)  # a row per group
        best = stage(_best(_losses(tried, around, by), by)).frame
    return best


def _best(grid: DataFrame, by: str) -> DataFrame:
    return grid.groupBy(by).agg(F.min_by(F.struct("log_t", "nll"), F.struct("nll", F.abs("log_t"))).alias("x")).select(by, "x.*")


def bisect_temperature(df: DataFrame, by: str = "model", rounds: int = 6, width: int = 24) -> DataFrame:
    """(by, log_t): where the slope of the mean loss in the log temperature changes its sign, in [-3, 3]; a check of ``fit_temperature``.

    Every round cuts the interval into ``width + 1`` and keeps the part in which the slope turns from falling to rising.
    """
    folded = stage(margins(df, by)).frame
    at = folded.select(by).distinct().select(by, F.lit(-3.0).alias("low"))
    part = 6.0
    for _ in range(rounds):
        part /= width + 1
        tried = folded.join(F.broadcast(at), by).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(width)))).withColumn("m", F.col("margin") / F.exp(F.col("low") + F.col("i") * part))
        # the slope at each point: m / t times the chance of the other class there
        slope = tried.groupBy(by, "low", "i").agg(F.sum(F.col("count") * F.col("m") / (1 + F.exp(F.col("m")))).alias("slope"))
        falling = slope.groupBy(by, "low").agg(F.coalesce(F.max(F.when(F.col("slope") < 0, F.col("i"))), F.lit(0)).alias("i"))
        at = stage(falling.select(by, (F.col("low") + F.col("i") * part).alias("low"))).frame
    return at.select(by, (F.col("low") + part / 2).alias("log_t"))


def calibrated(df: DataFrame, temperatures: DataFrame, by: str = "model") -> DataFrame:
    """``df`` with ``probabilities`` at the temperature of its group (by, log_t)."""
    held = df.join(F.broadcast(temperatures.select(by, F.exp("log_t").alias("__t"))), by)
    return held.withColumn("probabilities", softmax(log_probabilities(F.col("probabilities")), F.col("__t"))).drop("__t")


def with_discards(df: DataFrame, fitted: DataFrame, by: str = "model") -> DataFrame:
    """``df`` with ``discard``: for each policy of its group (by, policy, threshold) whether the row would be skipped. A group has a handful of policies."""
    rules = fitted.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("policy", "threshold"))).alias("__rules"))
    p0, p1 = F.col("probabilities")[0], F.col("probabilities")[1]
    return df.join(F.broadcast(rules), by, "left").withColumn("discard", F.transform_values("__rules", lambda _, threshold: skip(p0, p1, threshold))).drop("__rules")
