"""Near-duplicate groups by a token-group matrix.

Documents with equal word-run sets are one class. Classes with the same minimum hash form groups of at
most ``BLOCK``; a larger family of edited copies is first held against its smallest member, and those that
prove similar to it form groups that need not look at each other again; nor do those of leaders that are linked, and
others that look alike are held against the leader before any group of its family is opened. The matrix has a cell for
each prefix run and group: the group's token union, with the members that hold the run. A query
class meets a group only in that matrix; the number of its runs in the union bounds what it
can share with any member, and only groups that reach the bound are opened.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.graph import connected_components
from quillstone.operators.similarity import Postings, id_filter, prefixes, shared_needed, sizes_fit, verify
from quillstone.operators.sketch import count_sketch
from quillstone.operators.skew import skew_join
from quillstone.staging import Buckets, Stage, stage

BLOCK = 64
#: log2 of the buckets that count the families' classes.
FAMILY_BITS = 20


def near_duplicate_groups(docs: DataFrame, t: float = 0.8, k: int = 5) -> DataFrame:
    """(id, class_id, group_id) of every document of ``docs`` (id long, text string).

    ``class_id`` is the smallest id with the same set of word runs, ``group_id`` the smallest id that is
    linked by similarities of at least ``t``, also through others. Links are not counted: within a large family those that
    change no group are never looked for. Texts that are null or without words are one class;
    an empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    written: list[Stage] = []  # dropped at the end, as only members and groups are read from then on

    def keep(s: Stage) -> DataFrame:
        written.append(s)
        return s.frame

    p = prefixes(docs, t, k)
    classes = p.members.groupBy("class_id").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("min_hash").alias("min_hash"), F.first("sig").alias("sig"))
    families = classes.groupBy("min_hash").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("class_id", "rep", "sig"), "class_id").alias("leader"))
    placed = keep(stage(classes.join(families, "min_hash").select("class_id", "rep", "copies", "min_hash", "sig", "n", "leader")))

    # Families beyond a block: which members are similar to their leader?
    agree = sum(((F.shiftrightunsigned(F.col("sig").bitwiseXOR(F.col("leader.sig")), 15 * i).bitwiseAND(F.lit(0x7FFF))) == 0).cast("int") for i in range(4))
    star = placed.where((F.col("n") > BLOCK) & (F.col("class_id") != F.col("leader.class_id")) & (agree >= 3))
    proven = keep(stage(verify(star.select(F.col("leader.rep").alias("a"), F.col("rep").alias("b")), docs, t, k)))
    # A leader with fewer followers than a block saves nothing; its links stand all the same.
    heads = _heads(proven.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BLOCK).select("id"), docs, t, k)
    settled = proven.join(heads, "a").select(F.col("b").alias("rep"), F.col("head").alias("lead")).union(heads.select("a", "head"))

    held = keep(stage(placed.where(F.col("n") > BLOCK).join(settled, "rep").select("class_id", "lead")))
    sketch = count_sketch(classes.select("min_hash"), lambda b: iter([b["min_hash"].to_numpy().view(np.uint64)]), FAMILY_BITS)
    shared = p.postings(docs.sparkSession.sparkContext.broadcast(sketch), BLOCK)
    if p.hot_at is not None:
        shared = keep(stage(shared))
    columns = ["token", "class_id", "size", "family"]

    def placed_cells(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of small families as they are, and of large ones with their leaders."""
        led = rows.where("large").join(held, "class_id", "left").select(*columns, "lead")
        return rows.where("not large").select(*columns, F.lit(None).cast("long").alias("lead")), led

    # part 0: rows of small families; 1: of large ones as they come; 2: these with their leaders
    part = F.when(F.col("large"), 1).otherwise(0).alias("part")
    table = Buckets(shared.where("not hot").dropDuplicates(["token", "class_id"]).select(*columns, F.lit(None).cast("long").alias("lead"), part), "token", "part")
    led = table.frame.where("part = 1").drop("lead").join(held, "class_id", "left")
    table.add(led.select(*columns, "lead", F.lit(2).alias("part")))
    written.append(table)
    hot = None
    if p.hot_at is not None:
        small, large = placed_cells(shared.where("hot").dropDuplicates(["token", "class_id"]))
        hot = keep(stage(small.union(large)))
    cells = Postings(table.frame.where("part in (0, 2)").select(*columns, "lead"), hot)
    matrix = cells.each(lambda rows: rows.groupBy("token", "family", "lead").agg(F.collect_list(F.struct("class_id", "size")).alias("held")))

    def asking(rows: DataFrame) -> DataFrame:
        leads = rows.groupBy("token").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi"))
        return rows.join(leads, "token").where("lead is null or lo < hi").select("token", F.col("class_id").alias("q"), F.col("size").alias("q_size"), F.col("lead").alias("q_lead"))

    peers = (F.col("q_lead").isNull() == F.col("lead").isNull()) & ((F.col("q_lead") != F.col("lead")) | F.col("lead").isNull())
    opened = _opened(cells.each(asking).join(matrix).where(peers), t, smaller_only=True)
    reps = placed.select("class_id", "rep")
    known = proven.select("a", "b").union(heads.where("a <> head").select("head", "a"))
    if not held.isEmpty():
        asked, adopted = _adopt(cells.cold, reps, docs, t, k, cells.hot)
        known = known.union(adopted)
        opened = opened.union(_opened(asked.join(matrix.each(lambda rows: rows.where("lead is not null")), ("token", "lead")), t, smaller_only=False))
    counted = opened.select("q", "q_size", F.explode("held").alias("m")).groupBy("q", "q_size", "m").count()
    candidates = counted.where(F.col("count") >= shared_needed(F.col("m.size"), F.col("q_size"), t)).select("q", F.col("m.class_id").alias("m"))

    named = candidates.join(reps.select(F.col("class_id").alias("q"), F.col("rep").alias("a")), "q").join(reps.select(F.col("class_id").alias("m"), F.col("rep").alias("b")), "m")
    pairs = stage(named.select("a", "b"))
    links = keep(stage(verify(pairs.frame, docs, t, k).select("a", "b").union(known).distinct()))
    pairs.drop()
    roots = connected_components(links)
    named_classes = placed.select("class_id", "rep", "copies")
    by_class = stage(named_classes.join(roots, F.col("rep") == F.col("node"), "left").select("class_id", F.col("rep").alias("copy_of"), "copies", F.coalesce("root", "rep").alias("group_id"))).frame
    for s in [*written, *p.stages[1:]]:
        s.drop()
    return skew_join(p.members.select("id", "class_id"), by_class, "class_id", "copies").select("id", F.col("copy_of").alias("class_id"), "group_id")


def _heads(leaders: DataFrame, docs: DataFrame, t: float, k: int) -> DataFrame:
    """(a, head) for each leader: the smallest leader that it is linked to among the leaders, found as for all documents."""
    leaders = stage(leaders).frame
    if leaders.count() < 2:
        return leaders.select(F.col("id").alias("a"), F.col("id").alias("head"))
    texts = stage(id_filter(docs.select("id", "text"), leaders).join(leaders, "id", "left_semi")).frame
    return stage(near_duplicate_groups(texts, t, k).select(F.col("id").alias("a"), F.col("group_id").alias("head"))).frame


def _opened(met: DataFrame, t: float, smaller_only: bool) -> DataFrame:
    """Of the cells that queries meet, the groups that reach the bound, with the members held: q, q_size, held."""
    fits = lambda m: sizes_fit(m["size"], F.col("q_size"), t)
    held = F.filter("held", (lambda m: (m["class_id"] < F.col("q")) & fits(m)) if smaller_only else fits)
    met = met.withColumn("held", held).where(F.size("held") > 0)
    met = met.withColumn("bound", F.array_min(F.transform("held", lambda m: shared_needed(m["size"], F.col("q_size"), t))))
    groups = met.groupBy("q", "q_size", "family", "lead").agg(F.count(F.lit(1)).alias("overlap"), F.min("bound").alias("bound"), F.flatten(F.collect_list("held")).alias("held"))
    return groups.where("overlap >= bound").select("q", "q_size", "held")


def least_shared(lo: Column, hi: Column, size: Column, t: float) -> Column:
    """At most the least that ``shared_needed`` asks of a set of ``size`` runs and any of ``lo`` to ``hi`` runs.

    Up to ``size`` it grows with the other's size; beyond, it falls but for its ceilings, and so may lie one below its value at ``hi``.
    """
    return F.greatest(F.least(shared_needed(lo, size, t), shared_needed(hi, size, t)) - F.lit(1), F.lit(1))


def _adopt(cells: DataFrame, reps: DataFrame, docs: DataFrame, t: float, k: int, hot: DataFrame | None = None) -> tuple[Postings, DataFrame]:
    """Queries without a leader against families with one, as a whole first.

    Where the overlap with the family's union reaches the bound, the query is held against the leader: if similar it is linked (a, b)
    and done with that family. The others (token, q, q_size, lead) must have its groups opened.
    """
    both = Postings(cells, hot)
    free = both.each(lambda rows: rows.where("lead is null").select("token", F.col("class_id").alias("q"), F.col("size").alias("q_size")))
    span = both.all().where("lead is not null").groupBy("lead").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    met = free.join(both.each(lambda rows: rows.where("lead is not null").select("token", "lead").distinct()))
    touch = met.groupBy("q", "q_size", "lead").agg(F.count(F.lit(1)).alias("overlap")).join(span, "lead")
    lo, hi = F.greatest(F.col("lo"), F.ceil(F.lit(t) * F.col("q_size") - F.lit(1e-9))), F.least(F.col("hi"), F.floor(F.col("q_size") / F.lit(t) + F.lit(1e-9)))
    near = stage(touch.where((lo <= hi) & (F.col("overlap") >= least_shared(lo, hi, F.col("q_size"), t))).join(reps.select(F.col("class_id").alias("q"), "rep"), "q").select("q", "rep", "lead")).frame
    adopted = stage(verify(near.select(F.col("lead").alias("a"), F.col("rep").alias("b")), docs, t, k).select("a", "b")).frame
    left = near.join(adopted, (F.col("lead") == F.col("a")) & (F.col("rep") == F.col("b")), "left_anti").select("q", "lead")
    return free.each(lambda rows: rows.join(left, "q").select("token", "lead", "q", "q_size")), adopted


def groups_of_two(found: DataFrame) -> DataFrame:
    """Members of groups with at least two documents."""
    found = stage(found).frame
    sizes = found.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return skew_join(found, sizes, "group_id", "n")
