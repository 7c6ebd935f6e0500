"""Exact set-similarity search on word runs, for collections too large for pairwise comparison.

Two documents whose word-run sets have a Jaccard similarity of at least ``t`` share one of the first
``n - ceil(t n) + 1`` runs of either under any common order of runs (prefix filter). The order here is
rarest first, as told by a counting sketch of fixed size over all documents; it decides the work
only, never the result. Equal sets are folded into one class before anything is joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.shingling import distinct_sets, fingerprints, mix
from quillstone.operators.sketch import Counter, bucket, count_sketch, decoded, few_tasks, merged_sketch, sketch_counts
from quillstone.session import spread
from quillstone.staging import Stage, stage, stage_bucketed

#: Bounds of the sketch's width (log2; 2 bytes an entry are broadcast, 8 and 64 MB): between them it has an entry for some twenty runs.
SKETCH_BITS, MOST_BITS = 22, 25
#: Characters of text for each entry, as a run begins at every word.
CHARS_AN_ENTRY = 100
MEMBER_BITS = 23
#: A run is hot if more than so many documents and more than a ``HOT_SHARE``-th of all hold it, and is then dealt to ``HOT_SALTS`` tasks.
HOT_RUN, HOT_SHARE, HOT_SALTS = 10_000, 500, 16
#: Pairs of one first text that a task verifies.
PAIRS_A_TASK = 2000
#: Seeds of the four extra minimum hashes of a document.
SIGNATURES = 4


def prefix_length(size: int | np.ndarray, t: float):
    """How many of ``size`` runs, in the common order, must contain one that a similar set shares."""
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def shared_needed(x: Column, y: Column, t: float) -> Column:
    """The least number of common runs within both prefixes that sets of x and y runs need for similarity t."""
    least = F.ceil(F.lit(t / (1 + t)) * (x + y) - F.lit(1e-9))
    return least - F.greatest(F.ceil(F.lit(t) * x - F.lit(1e-9)), F.ceil(F.lit(t) * y - F.lit(1e-9))) + F.lit(1)


def sizes_fit(x: Column, y: Column, t: float) -> Column:
    return (F.least(x, y) + F.lit(1e-9)) >= F.lit(t) * F.greatest(x, y)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch["text"].to_pylist()]


@dataclass
class Postings:
    """Rows of runs (token): those of hot runs lie apart and are joined with salt, the others are bucketed by token."""

    cold: DataFrame
    hot: DataFrame | None

    def each(self, change: Callable[[DataFrame], DataFrame]) -> Postings:
        return Postings(change(self.cold), None if self.hot is None else change(self.hot))

    def join(self, other: Postings, on: tuple[str, ...] = ("token",)) -> DataFrame:
        """Inner join: without a shuffle for what is bucketed; of a hot run this side's rows are dealt out, and the other's repeated."""
        met = self.cold.join(other.cold, list(on))
        if self.hot is None or other.hot is None:
            return met
        dealt = self.hot.withColumn("__salt", F.pmod(F.xxhash64(*self.hot.columns), F.lit(HOT_SALTS)).cast("int"))
        repeated = other.hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))))
        return met.unionByName(dealt.join(repeated, [*on, "__salt"]).drop("__salt"))

    def all(self) -> DataFrame:
        return self.cold if self.hot is None else self.cold.unionByName(self.hot)


@dataclass
class Prefixes:
    """``members``: a row per document (id, class_id, size, min_hash, sig). ``hot_at``: documents from which a run is hot, None if no run is."""

    members: DataFrame
    stages: list[Stage]
    docs: DataFrame
    load: Broadcast
    t: float
    k: int
    bits: int
    hot_at: float | None

    def postings(self, families: Broadcast | None = None, block: int = 64) -> DataFrame:
        """A row per class and prefix run that another class has too (or that is hot): token, class_id, size, family, large, hot.

        ``families``: a counting sketch of the classes' minimum hashes. Those above ``block`` are large; their classes are
        dealt to blocks, ``family`` being a hash of minimum hash and block. Copies may repeat a row.
        """
        t, k, bits, load, hot_at = self.t, self.k, self.bits, self.load, self.hot_at

        def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()  # classes this task has sent: copies add no postings
            for batch in batches:
                for _, hashes, runs in fingerprints(_texts(batch), k):
                    d, h, n = distinct_sets(hashes, runs)
                    start = np.cumsum(n) - n
                    with np.errstate(over="ignore"):
                        cls, low = _class_ids(h, n, start), mix(h[start])
                        count = np.ones(len(n)) if families is None else sketch_counts(families.value, low)
                        part = cls % np.ceil(count / block).astype(np.uint64)
                        family = np.where(count > block, mix(low + part), low)
                    fresh = np.zeros(len(n), dtype=bool)
                    for i, c in enumerate(cls.tolist()):
                        if c not in seen:
                            seen.add(c)
                            fresh[i] = True
                    level = load.value[bucket(h, bits)]
                    rank = level.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16)
                    firsts = prefix_length(n, t)
                    at = [a + rank[a:b].argsort(kind="stable")[:p] for a, b, p, new in zip(start.tolist(), (start + n).tolist(), firsts.tolist(), fresh) if new]
                    at = np.concatenate(at) if at else np.zeros(0, np.int64)
                    of = d[at]
                    yield pa.RecordBatch.from_pydict({
                        "token": pa.array(h[at].view(np.int64)), "class_id": pa.array(cls[of].view(np.int64)), "size": pa.array(n[of].astype(np.int32)),
                        "family": pa.array(family[of].view(np.int64)), "large": pa.array((count > block)[of]),
                        "hot": pa.array(np.zeros(len(at), bool) if hot_at is None else decoded(level[at]) > hot_at),
                    })

        every = self.docs.select("text").mapInArrow(wide, "token long, class_id long, size int, family long, large boolean, hot boolean")
        same = Window.partitionBy("token") if hot_at is None else Window.partitionBy("token", F.when(F.col("hot"), F.col("class_id")))  # a hot run is shared for certain
        return every.withColumns({"lo": F.min("class_id").over(same), "hi": F.max("class_id").over(same)}).where("lo < hi or hot").drop("lo", "hi")

    def written(self, rows: DataFrame, clustered: bool = False) -> Postings:
        """``rows`` with token, class_id and hot, each class once a token, written: hot runs apart, the others in buckets.

        ``clustered``: they come by token, as ``postings`` gives them.
        """
        if self.hot_at is not None:
            self.stages.append(stage(rows))
            rows = self.stages[-1].frame
        cold = rows.where("not hot").drop("hot")
        cold = stage_bucketed((cold if clustered and self.hot_at is None else cold.repartition("token")).dropDuplicates(["token", "class_id"]), "token")
        self.stages.append(cold)
        if self.hot_at is None:
            return Postings(cold.frame, None)
        hot = stage(rows.where("hot").drop("hot").dropDuplicates(["token", "class_id"]))
        self.stages.append(hot)
        return Postings(cold.frame, hot.frame)

    def drop(self) -> None:
        for s in self.stages:
            s.drop()


def prefixes(docs: DataFrame, t: float, k: int = 5, bits: int | None = None) -> Prefixes:
    """Classes and shared prefix runs of ``docs`` (id long, text string).

    Null texts count as empty; filter blank ones first if they shall not match each other. One pass over the texts gives both the
    classes and the counts of runs. ``bits``: log2 of the sketch's entries, else as wide as the texts ask for.
    """
    docs = spread(docs.select("id", "text"))
    if bits is None:
        chars = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 1
        bits = min(max(SKETCH_BITS, (chars // CHARS_AN_ENTRY).bit_length()), MOST_BITS)
    schema = "id long, class_id long, size int, min_hash long, sig long, chunk int, counts binary"

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(bits)
        for batch in batches:
            ids, texts = batch["id"].to_numpy(zero_copy_only=False), _texts(batch)
            for begin, hashes, runs in fingerprints(texts, k):
                counter.add(hashes)
                d, h, n = distinct_sets(hashes, runs)
                start = np.cumsum(n) - n
                with np.errstate(over="ignore"):
                    cls = _class_ids(h, n, start)
                    sig = [np.minimum.reduceat(mix(h ^ np.uint64(0xA24BAED4963EE407 * (i + 1) & (2**64 - 1))), start) for i in range(SIGNATURES)]
                    yield pa.RecordBatch.from_pydict({
                        "id": pa.array(ids[begin : begin + len(n)]), "class_id": pa.array(cls.view(np.int64)), "size": pa.array(n.astype(np.int32)),
                        "min_hash": pa.array(mix(h[start]).view(np.int64)),
                        "sig": pa.array(sum(((s & np.uint64(0x7FFF)) << np.uint64(15 * i) for i, s in enumerate(sig)), np.zeros(len(n), np.uint64)).view(np.int64)),
                        "chunk": pa.nulls(len(n), pa.int32()), "counts": pa.nulls(len(n), pa.binary()),
                    })
        for chunk, counts in counter.chunks():
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_pydict({"id": none, "class_id": none, "size": pa.nulls(1, pa.int32()), "min_hash": none, "sig": none, "chunk": pa.array([chunk], pa.int32()), "counts": pa.array([counts], pa.binary())})

    both = stage(few_tasks(docs).mapInArrow(narrow, schema))
    load = merged_sketch(both.frame.where("chunk is not null"), bits)
    members = both.frame.where("chunk is null").select("id", "class_id", "size", "min_hash", "sig")
    hot_at: float | None = max(HOT_RUN, members.count() / HOT_SHARE)
    if not (decoded(load.max(initial=0)) > hot_at):
        hot_at = None
    return Prefixes(members, [both], docs, docs.sparkSession.sparkContext.broadcast(load), t, k, bits, hot_at)


def _class_ids(h: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each set, a 64-bit value of all its fingerprints."""
    first, second = np.add.reduceat(mix(h + np.uint64(0x632BE59BD9B4E019)), start), np.bitwise_xor.reduceat(mix(h ^ np.uint64(0xC3A5C85C97CB3127)), start)
    return mix(first ^ mix(second + n.astype(np.uint64)))


def id_filter(df: DataFrame, ids: DataFrame, column: str = "id", bits: int = MEMBER_BITS) -> DataFrame:
    """Rows of ``df`` whose id may be among ``ids``: a bitmap of 2**bits entries, so a shuffle of texts is spared."""

    def hashed(values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(values.astype(np.int64).view(np.uint64))

    held = count_sketch(ids.select(F.col(ids.columns[0]).alias("id")), lambda b: iter([hashed(b["id"].to_numpy(zero_copy_only=False))]), bits)
    bitmap = df.sparkSession.sparkContext.broadcast(np.packbits(held > 0))

    @F.pandas_udf("boolean")
    def may_be(v: pd.Series) -> pd.Series:
        at = bucket(hashed(v.to_numpy()), bits)
        return pd.Series((bitmap.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    return df.where(F.col(column).isNotNull()).where(may_be(F.col(column)))


def verify(pairs: DataFrame, docs: DataFrame, t: float, k: int = 5) -> DataFrame:
    """Of ``pairs`` (a, b: ids of ``docs``), those whose texts have similarity t or more, with it.

    The texts' sets of runs are made anew and compared by 64-bit fingerprints, so two different runs are taken for one with a chance of
    2**-64. Pairs of a first text that stands in many are dealt to tasks of ``PAIRS_A_TASK``, each of which gets that text once and makes
    its set once.
    """

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # pairs come by their first text
        for batch in batches:
            ids, firsts, seconds = batch["a"].to_pylist(), batch["text_a"], [x or "" for x in batch["text_b"].to_pylist()]
            new = [i for i, a in enumerate(ids) if a != (ids[i - 1] if i else last)]
            sets = _sets([*[firsts[i].as_py() or "" for i in new], *seconds], k)
            heads = dict(zip(new, sets))
            score = []
            for i, y in enumerate(sets[len(new) :]):
                held = heads.get(i, held)
                same = len(np.intersect1d(held, y, assume_unique=True))
                score.append(same / (len(held) + len(y) - same))
            last = ids[-1] if ids else last
            s = np.array(score)
            keep = pa.array(s >= t - 1e-12, pa.bool_())
            yield pa.RecordBatch.from_pydict({"a": batch["a"].filter(keep), "b": batch["b"].filter(keep), "similarity": pa.array(s, pa.float64()).filter(keep)})

    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = id_filter(docs.select("id", "text"), needed).repartition("id")
    parts = F.ceil(F.coalesce("__n", F.lit(1)) / PAIRS_A_TASK)
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PAIRS_A_TASK)
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("__salt"))
    first = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).join(many, "a", "left").select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("__salt"))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "a", "__salt")  # few bytes, but much work: small files or partitions must not end up as one task
    sides = dealt.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(first, ["a", "__salt"])
    return sides.select("a", "b", "text_a", "text_b").mapInArrow(exact, "a long, b long, similarity double")


def _sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Each text's distinct fingerprints."""
    out: list[np.ndarray] = []
    for _, hashes, runs in fingerprints(texts, k):
        _, h, n = distinct_sets(hashes, runs)
        out += np.split(h, np.cumsum(n)[:-1])
    return out


def class_pairs(postings: Postings, t: float) -> DataFrame:
    """Pairs of classes (a < b) that share enough prefix runs for similarity t."""
    left = postings.each(lambda rows: rows.select("token", F.col("class_id").alias("a"), F.col("size").alias("size_a")))
    right = postings.each(lambda rows: rows.select("token", F.col("class_id").alias("b"), F.col("size").alias("size_b")))
    joined = left.join(right).where(F.col("a") < F.col("b")).where(sizes_fit(F.col("size_a"), F.col("size_b"), t))
    return joined.groupBy("a", "b", "size_a", "size_b").count().where(F.col("count") >= shared_needed(F.col("size_a"), F.col("size_b"), t)).select("a", "b")


def representatives(members: DataFrame) -> DataFrame:
    """class_id, its smallest id and how many documents it has."""
    return members.groupBy("class_id").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


def similar_pairs(docs: DataFrame, t: float, k: int = 5) -> tuple[DataFrame, DataFrame, Prefixes]:
    """Pairs (a, b, similarity) of class representatives, the representatives, and the memberships behind them."""
    p = prefixes(docs, t, k)
    reps = representatives(p.members)
    c = class_pairs(p.written(p.postings().select("token", "class_id", "size", "hot"), clustered=True), t)
    named = c.join(reps.select(F.col("class_id").alias("a"), F.col("id").alias("ra")), "a").join(reps.select(F.col("class_id").alias("b"), F.col("id").alias("rb")), "b")
    pairs = stage(named.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")))
    p.stages.append(pairs)
    return verify(pairs.frame, docs, t, k), reps, p
