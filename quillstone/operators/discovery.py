"""Finding what to read: range subdivision, category crawls, re-chunked archives, merged providers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.staging import stage


def subdivide(days: DataFrame, cap: int) -> DataFrame:
    """(first_day, last_day, rows, capped): month ranges of ``days`` (day date, n), halved while they hold more than ``cap`` rows.

    A single day above the cap is ``capped``. Works on counts per day; every round halves all ranges that are too large at once.
    """
    month = F.trunc("day", "month")
    ranges = days.groupBy(month.alias("first_day")).agg(F.sum("n").alias("rows")).select("first_day", F.last_day("first_day").alias("last_day"), "rows")
    done, todo = ranges.where(F.col("rows") <= cap), stage(ranges.where(F.col("rows") > cap)).frame
    for _ in range(5):  # a month has at most 2**5 days
        middle = F.date_add("first_day", F.floor(F.datediff("last_day", "first_day") / 2).cast("int"))
        halves = todo.where("first_day < last_day").select(F.explode(F.array(F.struct(F.col("first_day"), middle.alias("last_day")), F.struct(F.date_add(middle, 1).alias("first_day"), F.col("last_day")))).alias("r")).select("r.*")
        single = todo.where("first_day = last_day")
        counted = halves.join(days, F.col("day").between(F.col("first_day"), F.col("last_day")), "left").groupBy("first_day", "last_day").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
        done = done.unionByName(counted.where((F.col("rows") <= cap) & (F.col("rows") > 0))).unionByName(single)
        todo = stage(counted.where(F.col("rows") > cap)).frame
    return done.unionByName(todo).select("first_day", "last_day", "rows", (F.col("rows") > cap).alias("capped"))


def crawl(links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, depth, via): everything reached from ``roots`` (node) over ``links`` (parent, child) within ``depth`` steps, at its first depth."""
    seen = roots.select("node", F.lit(0).alias("depth"), F.lit(None).cast(roots.schema["node"].dataType).alias("via")).dropDuplicates(["node"])
    frontier = seen
    for step in range(1, depth + 1):
        reached = links.join(frontier, links["parent"] == frontier["node"]).groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("via"))
        frontier = stage(reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(step).alias("depth"), "via")).frame
        seen = seen.unionByName(frontier)
    return seen


def rechunk(rows: DataFrame, key: str, values: str, header: list[str]) -> DataFrame:
    """(key, record, header...): every len(header) values of a flat array are one record, numbered from 0, without a shuffle.

    An array whose length is no multiple of the header's is an error; null and empty arrays have no records.
    """
    width, size = len(header), F.size(values)
    checked = F.when(size % width == 0, F.col(values)).otherwise(F.raise_error(F.concat(F.lit("an array of "), size.cast("string"), F.lit(f" values can't be cut into records of {width}"))).cast(rows.schema[values].dataType))
    record = lambda r: F.struct(r.cast("int").alias("record"), *[F.get(F.col("__v"), r * width + i).alias(name) for i, name in enumerate(header)])
    held = rows.where(size > 0).select(key, checked.alias("__v"))
    return held.select(key, F.explode(F.transform(F.sequence(F.lit(0), (F.size("__v") / width).cast("int") - 1), record)).alias("__r")).select(key, "__r.*")


def merge_providers(providers: list[DataFrame], key: str) -> DataFrame:
    """All providers' rows by name, missing columns null; for one key the last provider wins."""
    out = None
    for i, p in enumerate(providers):
        part = p.withColumn("provider", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    row = F.struct(*out.columns)
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(set(out.columns) - {"provider"})]
    return out.groupBy(key).agg(F.max_by(row, F.struct("provider", *rest)).alias("r")).select("r.*")
