"""Splits that keep related records together: frontier breadth-first components, split by hash order."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.skew import skew_join
from quillstone.staging import Stage, cut, stage

#: Positions in a family's hash order that a part of its dates is cut into.
HASH_BUCKETS = 1024


def frontier_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; ``edges`` (u, v) of random-looking strings.

    The adjacency lists lie hash-partitioned by node. Every node smaller than all its neighbours is a seed;
    all seeds' frontiers expand at once until each node carries a label. Edges between different labels
    form a graph of labels of at most half the nodes, which is treated the same way, until none are left.
    """
    levels: list[DataFrame] = []
    graph = stage(edges.where("u <> v").select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*").distinct())
    while True:
        labels = _expand(graph.frame)
        levels.append(labels)
        ends = graph.frame.join(labels.select(F.col("node").alias("u"), F.col("label").alias("lu")), "u").join(labels.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
        collided = stage(ends.where("lu <> lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct())
        graph.drop()
        graph = collided
        if collided.frame.isEmpty():
            break
    return reduce(lambda low, high: low.join(high.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label")), levels)


def _expand(adjacency: DataFrame) -> DataFrame:
    """Breadth-first labels from all local minima; every node descends to one, so all are reached."""
    frontier = stage(adjacency.groupBy("u").agg(F.min("v").alias("m")).where("u < m").select(F.col("u").alias("node"), F.col("u").alias("label")))
    done: list[Stage] = [frontier]
    while not frontier.frame.isEmpty():
        seen = reduce(DataFrame.union, [s.frame.select("node") for s in done])
        reached = adjacency.join(frontier.frame, adjacency["u"] == F.col("node")).select(F.col("v").alias("node"), "label")
        frontier = stage(reached.join(seen, "node", "left_anti").groupBy("node").agg(F.min("label").alias("label")))
        done.append(frontier)
    return reduce(DataFrame.union, [s.frame for s in done])


def related_groups(records: DataFrame, keys: list[str]) -> DataFrame:
    """(id, group_id, members): records that share a value in one of the string columns ``keys``, also through others.

    ``group_id`` is the smallest id of the group. Null keys relate nothing; a record without a shared key
    is its own group; a null id is dropped, repeated ids count as one record; an empty table gives an empty
    result; columns other than ``id`` and ``keys`` are ignored. Records are edges between key values here: a value
    that a third of all records hold is one node, counted before it is shuffled, and looked up with salt.
    """
    base = records.where(F.col("id").isNotNull()).select("id", *keys)
    named = base.select("id", F.explode(F.array(*[F.when(F.col(k).isNotNull(), F.md5(F.concat_ws("\x1f", F.lit(k), F.col(k)))) for k in keys])).alias("node")).where("node is not null").distinct()
    shared = named.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = stage(skew_join(named, stage(shared).frame, "node", "n").select("id", "node"))
    per_record = held.frame.groupBy("id").agg(F.array_sort(F.collect_set("node")).alias("nodes"))
    anchors = stage(per_record)
    links = anchors.frame.where(F.size("nodes") > 1).select(F.explode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("u"), F.slice("nodes", 2, F.size("nodes") - 1).alias("v"))).alias("e")).select("e.u", "e.v").distinct()
    labels = frontier_components(links)
    anchored = anchors.frame.select("id", F.col("nodes")[0].alias("node"))
    sized = anchored.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    components = sized.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    totals = components.groupBy("label").agg(F.min("least").alias("group_id"), F.sum("n").alias("members"))
    by_node = components.select("node", "label", "n").join(totals, "label").select("node", "n", "group_id", "members")
    grouped = skew_join(anchored, cut(by_node), "node", "n").select("id", "group_id", "members")
    alone = base.select("id").distinct().join(anchored.select("id"), "id", "left_anti").select("id", F.col("id").alias("group_id"), F.lit(1).cast("long").alias("members"))
    return grouped.union(alone)


def assign_splits(records: DataFrame, groups: DataFrame, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """(id, group_id, split): whole groups to train, validation and test in the given shares, in every family and over time.

    ``records`` has id, family, day (yyyy-MM-dd or any string, null allowed). A group counts in the family and quarter of its
    smallest record. Within a family groups stand in the order of quarter and component hash; each goes to the split that is
    then furthest below its share of all records so far, so the shares hold at every point of time as closely as whole groups
    allow, and a group that is too large for validation or test goes to train because train alone lacks so many.
    """
    day = F.col("day")
    quarter = F.concat(F.substring(day, 1, 4), F.lit("q"), F.ceil(F.try_to_number(F.substring(day, 6, 2), F.lit("99")) / 3).cast("string"))
    facts = records.select("id", F.coalesce("family", F.lit("none")).alias("family"), F.coalesce(quarter, F.lit("none")).alias("quarter"))
    heads = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).join(facts.dropDuplicates(["id"]), F.col("group_id") == F.col("id")).drop("id")
    bucket: Column = F.pmod(F.xxhash64("group_id"), F.lit(HASH_BUCKETS))
    heads = stage(heads.withColumn("bucket", bucket)).frame
    # quarters x HASH_BUCKETS rows a family at most, whatever the number of records
    cells = heads.groupBy("family", "quarter", "bucket").agg(F.sum("n").alias("n"))
    wanted = {"train": train, "validation": validation, "test": 1 - train - validation}

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["quarter", "bucket"])
        short, split = dict.fromkeys(wanted, 0.0), []
        for n in rows["n"].tolist():
            for s, share in wanted.items():
                short[s] += share * n
            chosen = max(short, key=short.__getitem__)
            short[chosen] -= n
            split.append(chosen)
        rows["split"] = split
        return rows[["family", "quarter", "bucket", "split"]]

    placed = cells.groupBy("family").applyInPandas(assign, "family string, quarter string, bucket long, split string")
    sizes = heads.join(placed, ["family", "quarter", "bucket"]).select("group_id", "n", "split")
    return skew_join(groups.select("id", "group_id"), cut(sizes), "group_id", "n").select("id", "group_id", "split")
