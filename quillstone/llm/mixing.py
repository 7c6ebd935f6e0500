"""Mixing sources to target token shares by Poisson replication."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.tokens import VOCABULARY, tokens_of
from quillstone.session import spread
from quillstone.staging import stage

#: Rates of the Poisson distribution that are told apart; the last one means as often as permitted.
RATES = 4096
_GRID = np.append(14.0 * (np.arange(RATES - 1) / (RATES - 2)) ** 2, np.inf)


def _at_least(k: int) -> np.ndarray:
    """P(X >= k) at each rate."""
    rate = _GRID[:-1]
    term, below = np.exp(-rate), np.zeros_like(rate)
    for i in range(k):
        below += term
        term = term * rate / (i + 1)
    return np.append(np.clip(1.0 - below, 0.0, 1.0), 1.0 + 1e-9)


def _jumps(u: Column, most: int) -> Column:
    """For k = 1..most, the first rate whose inverted distribution gives k or more at ``u``."""

    @F.arrow_udf("array<int>")
    def first(values: pa.Array) -> pa.Array:
        v = 1.0 - values.to_numpy(zero_copy_only=False)
        at = np.stack([np.minimum(np.searchsorted(np.maximum.accumulate(_at_least(k)), v, side="right"), RATES - 1) for k in range(1, most + 1)], axis=1)
        return pa.ListArray.from_arrays(np.arange(0, at.size + 1, most, dtype=np.int32), pa.array(at.ravel().astype(np.int32)))

    return first(u)


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 42, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture (position, doc_id, copy, source, tokens, text) and its shares per source.

    ``docs``: id, source, text; ``targets``: source, target_share, max_repeats. The size is the largest at which no
    source is used more often than its ``max_repeats``. Each document draws its number of copies from a Poisson
    distribution by inverting it at a uniform hash of seed and id, cut off at ``max_repeats``. The rate that gives a
    source its tokens is read off the summed jumps of all its documents, so the shares are met but for less than
    one document or so. Copies are shuffled by hash. Documents whose source has no target (or a null one), and null or
    empty texts, are left out; targets with no text count as unreachable, the others keep their proportions; repeated
    targets are merged; an empty table gives an empty mixture. ``position`` orders it.
    """
    goal = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    most = goal.agg(F.max("cap")).first()[0] or 1
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id")), 11) * F.lit(2.0**-53)
    targeted = spread(docs.select("id", "source", "text")).where(F.length("text") > 0).join(goal, "source")
    sized = stage(targeted.select("id", "source", "text", "share", "cap", tokens_of("text", vocabulary).alias("tokens"), _jumps(u, most).alias("jumps"))).frame
    narrow = sized.select("id", "source", "share", "cap", "tokens", "jumps")
    have = narrow.groupBy("source", "share", "cap").agg(F.sum("tokens").alias("have"))
    whole = Window.partitionBy()  # over one row per source
    wanted = have.withColumn("want", F.col("share") * F.min(F.col("have") * F.col("cap") / F.col("share")).over(whole))
    steps = narrow.select("source", "tokens", F.explode(F.slice("jumps", 1, F.col("cap"))).alias("rate")).groupBy("source", "rate").agg(F.sum("tokens").alias("gain"))
    reached = steps.withColumn("total", F.sum("gain").over(Window.partitionBy("source").orderBy("rate"))).join(F.broadcast(wanted), "source")
    rates = stage(reached.groupBy("source", "share", "cap", "have", "want").agg(F.min_by("rate", F.struct(F.abs(F.col("total") - F.col("want")), "rate")).alias("rate"))).frame
    copies = F.size(F.filter(F.slice("jumps", 1, F.col("cap")), lambda j: j <= F.col("rate")))
    chosen = sized.join(F.broadcast(rates.select("source", "rate")), "source").withColumn("copies", copies).where("copies > 0")
    drawn = chosen.select("id", "source", "tokens", "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    mixed = drawn.withColumn("position", F.xxhash64(F.lit(seed + 1), "id", "copy")).repartition("position").sortWithinPartitions("position")
    used = narrow.join(F.broadcast(rates.select("source", "rate", "want")), "source").select("source", "share", "cap", "tokens", "want", copies.alias("copies"))
    shares = used.groupBy("source", "share", "cap", "want").agg(F.sum("tokens").alias("available"), F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.sum("copies").alias("documents"), F.max("copies").alias("most"), F.max("tokens").alias("largest"))
    shares = shares.select(
        "source", F.col("share").alias("target_share"), F.round(F.col("used") / F.nullif(F.sum("used").over(whole), F.lit(0)), 6).alias("share"), "available", F.col("want").cast("long").alias("wanted"), "used", "documents", F.col("cap").alias("max_repeats"), F.col("most").alias("repeats"), "largest",
    )
    return mixed.select("position", F.col("id").alias("doc_id"), "copy", "source", "tokens", "text"), shares
