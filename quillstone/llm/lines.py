"""Lines that recur across one source's documents, by fixed-depth token trees with wildcard slots.

Every line is parsed along a tree: source, number of tokens, first token, second token, leaf. Runs of digits
are the wildcard slots, so lines that differ only there share a template; slots are not learnt, as what counts as alike is fixed. The tasks' trees are merged by adding up
how many documents pass a node; a node that fewer documents pass than a template needs is pruned with all its leaves
before these are counted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.skew import skew_join
from quillstone.session import spread
from quillstone.staging import stage

#: Templates that may be broadcast (8 bytes each).
BROADCAST_TEMPLATES = 2_000_000
ARROW = {"array<boolean>": pa.list_(pa.bool_()), "struct<text:string,removed:int>": pa.struct([("text", pa.string()), ("removed", pa.int32())])}

_LETTER = re.compile(r"[^\W\d_]")
_DIGITS = re.compile(r"[0-9]+")


def template(line: str) -> str | None:
    """A line's template: lowercased, white space collapsed, digit runs as one slot; None without a letter."""
    s = _DIGITS.sub("0", " ".join(line.lower().split()))
    return s if _LETTER.search(s) else None


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63) or 1


def leaf_of(line: str) -> int:
    """The leaf of a line's template, 0 where it has none."""
    s = template(line)
    return 0 if s is None else _hash(s)


def _nodes(s: str) -> tuple[int, int]:
    """The tree node above the leaf, and the leaf."""
    head = s.split(" ", 2)[:2]
    return _hash(f"{s.count(' ')} {' '.join(head)}"), _hash(s)


def parsed(docs: DataFrame) -> DataFrame:
    """(id, source, nodes, leaves): a node and a leaf for each line of ``text`` split at \\n, 0 where it is no template's."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            text = pc.fill_null(batch["text"], "")
            split = pc.split_pattern(text, "\n")
            encoded = pc.dictionary_encode(pc.list_flatten(split))
            pairs = []
            for line in encoded.dictionary.to_pylist():
                s = template(line)
                if s is None:
                    pairs.append((0, 0))
                    continue
                if s not in known:
                    if len(known) > 500_000:
                        known.clear()
                    known[s] = _nodes(s)
                pairs.append(known[s])
            lists = []
            for i in (0, 1):
                values = pa.array([p[i] for p in pairs], pa.int64()).take(encoded.indices)
                lists.append(pa.ListArray.from_arrays(split.offsets, values))
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "source": batch["source"], "nodes": lists[0], "leaves": lists[1]})

    return spread(docs.select("id", "source", "text")).mapInArrow(parse, "id long, source string, nodes array<long>, leaves array<long>")


def repeated_templates(lines: DataFrame, share: float = 0.02, least: int = 10) -> DataFrame:
    """(source, leaf, documents) of the templates that at least ``share`` of a source's documents and ``least`` of them hold.

    ``lines``: what ``parsed`` gives, written or not.
    """
    sizes = lines.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", F.greatest(F.lit(float(least)), F.lit(share) * F.col("n") - F.lit(1e-9)).alias("needed"))
    passing = lines.select("source", F.explode(F.array_distinct("nodes")).alias("node")).where("node <> 0").groupBy("source", "node").agg(F.count(F.lit(1)).alias("documents"))
    grown = stage(passing.where(F.col("documents") >= least).join(sizes, passing["source"].eqNullSafe(sizes["source"])).where("documents >= needed").select(passing["source"], "node", "needed")).frame
    leaves = lines.select("source", F.explode(F.array_distinct(F.arrays_zip("nodes", "leaves"))).alias("x")).select("source", F.col("x.nodes").alias("node"), F.col("x.leaves").alias("leaf"))
    counted = leaves.join(grown, leaves["source"].eqNullSafe(grown["source"]) & (leaves["node"] == grown["node"])).groupBy(leaves["source"], "leaf", "needed").agg(F.count(F.lit(1)).alias("documents"))
    return counted.where("documents >= needed").select("source", "leaf", "documents")


def repeated_lines(docs: DataFrame, share: float = 0.02, least: int = 10) -> DataFrame:
    """(id, line_no, source, documents): every line of ``docs`` (id, source, text) whose template recurs in its source.

    Lines are counted from 1. A template counts once a document. A null source is a source of its own; null texts
    have one empty line, which like all lines without a letter never counts. Repeated ids count as documents of their own.
    """
    lines = stage(parsed(docs)).frame
    found = stage(repeated_templates(lines, share, least)).frame
    each = lines.select("id", "source", F.posexplode("leaves").alias("at", "leaf")).where("leaf <> 0")
    return each.join(found, each["source"].eqNullSafe(found["source"]) & (each["leaf"] == found["leaf"])).select("id", (F.col("at") + 1).alias("line_no"), each["source"], "documents")


def by_source(found: DataFrame) -> dict[str | None, set[int]] | None:
    """The leaves of ``found`` (source, leaf) per source if there are at most ``BROADCAST_TEMPLATES``, else None.

    A source's templates are at most ``1 / share`` times the lines that its documents have on average; the number of sources has no bound.
    """
    if found.count() > BROADCAST_TEMPLATES:
        return None
    sets: dict[str | None, set[int]] = {}
    for row in found.select("source", "leaf").collect():
        sets.setdefault(row["source"], set()).add(row["leaf"])
    return sets


def with_templates(docs: DataFrame, found: DataFrame, act: Callable[[str, Collection[int]], object], kind: str) -> DataFrame:
    """``docs`` (id, source, text) with ``done``: what ``act`` makes of each text and the leaves of ``found`` of its source; None where the text is null.

    The leaves are broadcast once their number is known to be small; else each document is joined with its source's, sources that hold
    many documents being salted. The text is shuffled in that case only.
    """
    sets = by_source(found)
    if sets is not None:
        known = docs.sparkSession.sparkContext.broadcast(sets)

        @F.arrow_udf(kind)
        def done(texts: pa.Array, sources: pa.Array) -> pa.Array:
            return pa.array([None if x is None else act(x, known.value.get(s, ())) for x, s in zip(texts.to_pylist(), sources.to_pylist())], ARROW[kind])

        return spread(docs.select("id", "source", "text")).select("id", "source", "text", done("text", "source").alias("done"))

    @F.arrow_udf(kind)
    def done_joined(texts: pa.Array, leaves: pa.Array) -> pa.Array:
        return pa.array([None if x is None else act(x, frozenset(n or ())) for x, n in zip(texts.to_pylist(), leaves.to_pylist())], ARROW[kind])

    docs = docs.select("id", F.coalesce("source", F.lit("\0")).alias("source"), "text")
    leaves = found.groupBy(F.coalesce("source", F.lit("\0")).alias("source")).agg(F.collect_set("leaf").alias("leaves"))
    keyed = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(leaves, "source", "left")
    joined = skew_join(docs, stage(keyed).frame, "source", "n")
    return joined.select("id", F.nullif("source", F.lit("\0")).alias("source"), "text", done_joined("text", "leaves").alias("done"))


def _without(text: str, leaves: Collection[int]) -> dict[str, object]:
    lines = text.split("\n")
    kept = [x for x in lines if not (leaf := leaf_of(x)) or leaf not in leaves] if leaves else lines
    return {"text": "\n".join(kept), "removed": len(lines) - len(kept)}


def without_repeated_lines(docs: DataFrame, share: float = 0.02, least: int = 10) -> DataFrame:
    """(id, source, text, removed): every text of ``docs`` without those lines, and how many went; null stays null."""
    found = stage(repeated_templates(stage(parsed(docs)).frame, share, least).select("source", "leaf")).frame
    out = with_templates(docs, found, _without, "struct<text:string,removed:int>")
    return out.select("id", "source", F.col("done.text").alias("text"), F.coalesce("done.removed", F.lit(0)).alias("removed"))
