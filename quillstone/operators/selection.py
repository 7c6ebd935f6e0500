"""Choosing whole groups whose sizes add up to a wanted count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.ordering import rank_in_bucket, round_robin, running_totals
from quillstone.staging import stage


def group_order(rows: DataFrame, ahead: str | None = None) -> DataFrame:
    """(group_id, family, month, size, ordinal): groups interleaved over (smallest family, smallest month), by id within.

    ``ahead``: a family whose buckets all come before the others.
    """
    groups = rows.groupBy("group_id").agg(F.min("family").alias("family"), F.min(F.substring("day", 1, 7)).alias("month"), F.count(F.lit(1)).alias("size"))
    groups = groups.withColumn("bucket", F.concat_ws("|", "family", F.coalesce("month", F.lit(""))))
    lead = [F.when(F.col("family") == ahead, 0).otherwise(1)] if ahead else []
    return round_robin(groups, "bucket", ["group_id"], lead).drop("bucket", "rn")


#: Bits that ``exact_change`` may hold.
MOST_BITS = 1 << 33


def exact_change(rest: int, inside: dict[int, int], outside: dict[int, int]) -> dict[int, int] | None:
    """By size, how many more groups (or fewer, below 0) so that ``rest`` more members are chosen; None if there is no way.

    ``inside`` and ``outside`` hold how many groups of each size are chosen and are not. If there is a way at all, there is one that
    changes at most ``2 d + 1`` groups, d being the largest size, as an integer solution of one equation over bounded
    variables lies that near to a fractional one. So totals stay within ``d (2 d + 1)``; sizes are walked, not groups, and
    totals are the bits of one number. Small sizes are tried alone first.
    """
    every = sorted({*inside, *outside})
    limit = 64
    while True:
        used = [n for n in every if n <= limit]
        if used:
            found = _change(rest, used, inside, outside)
            if found is not None:
                return found
        if not every or limit >= every[-1]:
            return None
        limit *= 2


def _change(rest: int, used: list[int], inside: dict[int, int], outside: dict[int, int]) -> dict[int, int] | None:
    most = 2 * used[-1] + 1
    span = max(used[-1] * most, rest)
    steps: list[tuple[int, int]] = []  # (size, groups), counts as powers of two and what is left over
    for sign, held in ((1, outside), (-1, inside)):
        for size in used:
            left, k = min(held.get(size, 0), most), 1
            while left:
                k = min(k, left)
                steps.append((size, sign * k))
                left, k = left - k, k * 2
    if len(steps) * 2 * span > MOST_BITS:
        raise ValueError("too many sizes of groups to search for whole groups")
    full, at = (1 << (2 * span + 1)) - 1, span + rest
    reached = [1 << span]
    for size, k in steps:
        r = reached[-1]
        reached.append((r | (r << size * k if k > 0 else r >> -size * k)) & full)
        if reached[-1] >> at & 1:
            break
    if not reached[-1] >> at & 1:
        return None
    change: dict[int, int] = {}
    for (size, k), before in reversed(list(zip(steps, reached))):
        if not before >> at & 1:
            change[size] = change.get(size, 0) + k
            at -= size * k
    return change


def whole_groups(groups: DataFrame, count: int) -> DataFrame:
    """Groups (group_id, size, ordinal) with exactly ``count`` members in all, none split; an error if there is no such choice.

    The groups that come first are taken as long as all fit. What is then lacking is made up by size: the largest that fit, then the
    change of few groups that hits the count (``exact_change``). Of each size the first groups by ordinal are the chosen ones of
    those that join, and the last ones leave. The driver sees two rows per size, whatever the number of groups.
    """
    if count == 0:
        return groups.limit(0)
    fitting = groups.where(F.col("size") <= count).withColumn("__all", F.lit(0))
    summed = running_totals(fitting, "__all", [F.col("ordinal")], ["size"]).drop("__all")
    marked = summed.withColumn("__kind", F.concat(F.when(F.col("size_upto") <= count, "in:").otherwise("out:"), F.col("size").cast("string")))
    ranked = stage(rank_in_bucket(marked, "__kind", ["ordinal"], "__rank")).frame
    held: dict[str, dict[int, int]] = {"in": {}, "out": {}}
    for r in ranked.groupBy("__kind", "size").agg(F.count(F.lit(1)).alias("n")).collect():
        held[r["__kind"].split(":")[0]][r["size"]] = r["n"]
    inside, outside, more = held["in"], held["out"], {}
    rest = count - sum(size * n for size, n in inside.items())
    for size in sorted(outside, reverse=True):
        if k := min(outside[size], rest // size):
            more[size] = k
            rest -= size * k
    if rest:
        now = {s: inside.get(s, 0) + more.get(s, 0) for s in {*inside, *more}}
        change = exact_change(rest, now, {s: n - more.get(s, 0) for s, n in outside.items()})
        if change is None:
            raise ValueError(f"no whole groups add up to {count}")
        more = {s: more.get(s, 0) + change.get(s, 0) for s in {*more, *change}}
    upto = [(f"{side}:{size}", n + min(k, 0) if side == "in" else max(k, 0)) for side, sizes in held.items() for size, n in sizes.items() for k in [more.get(size, 0)]]
    limits = groups.sparkSession.createDataFrame(upto, "__kind string, __upto long")
    return ranked.join(F.broadcast(limits), "__kind").where(F.col("__rank") <= F.col("__upto")).select(*groups.columns)


def replace_groups(base: DataFrame, removable: DataFrame, additions: DataFrame) -> DataFrame:
    """``base`` with ``additions``, and whole ``removable`` groups of exactly as many rows taken out. Rows have group_id."""
    gone = whole_groups(removable, additions.count())
    return base.join(gone, "group_id", "left_anti").unionByName(additions, allowMissingColumns=True)


def allocate(groups: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """(group_id, size, ordinal, part): parts filled one after the other from a shared pool, chosen groups leaving it."""
    pool, out = groups, None
    for name, count in wanted.items():
        part = whole_groups(pool, count)
        pool = pool.join(part, "group_id", "left_anti")
        part = part.withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
