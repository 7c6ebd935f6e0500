"""Filling containers of permitted capacities with items: variable-capacity best fit, shard by shard."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.tokens import VOCABULARY, clean, encoder, pieces
from quillstone.session import spread
from quillstone.staging import stage

CAPACITIES = (256, 512, 1024, 2048)
#: Items packed together. A shard leaves few of its last containers part empty, so the loss is below one in a hundred.
SHARD_ITEMS = 5000
#: What opening a container costs besides its capacity, in tokens, and the length at which attention doubles the cost of a token. The
#: one speaks for long containers, the other for short ones: a full one of 512 is cheapest per token, if it can be filled as well.
OPENING, ATTENTION = 16.0, 16384.0
#: A stretch of so many characters never has more tokens than bytes, 4 each.
_ATOM = 512


def parts_of(column: str, capacity: int, vocabulary: str = VOCABULARY) -> Column:
    """array<struct<start,end,tokens>>: one part for a text within ``capacity`` tokens, else the fewest that whole words allow."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32())]))

    @F.arrow_udf("array<struct<start:int,end:int,tokens:int>>")
    def parts(texts: pa.Array) -> pa.Array:
        enc, kept = encoder(vocabulary), {}

        def size(p: str) -> int:
            if p not in kept:
                if len(kept) > 400_000:
                    kept.clear()
                kept[p] = len(enc.encode_ordinary(clean(p)))
            return kept[p]

        out = []
        for text in texts.to_pylist():
            done, start, end, held = [], 0, 0, 0
            for p in pieces(text or ""):
                n = size(p)
                atoms = [(p, n)] if n <= capacity else [(a, size(a)) for a in (p[i : i + min(_ATOM, capacity // 4)] for i in range(0, len(p), min(_ATOM, capacity // 4)))]
                for a, m in atoms:
                    if held + m > capacity:
                        done.append({"start": start, "end": end, "tokens": held})
                        start, held = end, 0
                    end += len(a)
                    held += m
            if end > start:
                done.append({"start": start, "end": end, "tokens": held})
            out.append(done)
        return pa.array(out, kind)

    return parts(F.col(column))


def cost(capacity: int, opening: float = OPENING, attention: float = ATTENTION) -> float:
    """What a container costs whatever it holds: its tokens, the attention among them, and its opening."""
    return capacity * (1 + capacity / attention) + opening


def _filled(first: int, capacity: int, there: int, count: list[int]) -> list[tuple[int, int]]:
    """(size, how many) of the items that fill a container best if ``first`` goes in: always the largest that still fits.

    ``there`` has a bit for each size of which ``count`` has items left.
    """
    chosen, room = [(first, 1)], capacity - first
    if count[first] == 1:
        there &= ~(1 << first)
    while room:
        n = (there & ((2 << room) - 1)).bit_length() - 1
        if n <= 0:
            break
        k = min(count[n] - (n == first), room // n)
        chosen.append((n, k))
        room -= n * k
        there &= ~(1 << n)
    return chosen


def best_fit(sizes: list[int], capacities: tuple[int, ...], opening: float = OPENING, attention: float = ATTENTION) -> tuple[list[int], list[int]]:
    """Container number of each item, and each container's capacity; items are of 1 token or more and fit the largest capacity.

    The largest item left opens a container. For each permitted capacity that it fits, the best filling with what is left
    is found, and the capacity of least cost per token filled is opened with that filling; so the lengths compete for
    the same items. At the end each container shrinks to the least capacity that holds its contents.
    """
    capacities = tuple(sorted(capacities))
    held: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        held.setdefault(n, []).append(i)
    count = [0] * (max(held, default=0) + 1)
    there = 0
    for n, items in held.items():
        items.reverse()  # taken from the end, first come first
        count[n] = len(items)
        there |= 1 << n
    place, shrunk = [0] * len(sizes), []
    while there:
        first = there.bit_length() - 1
        _, _, used, chosen = min(((cost(c, opening, attention) / (total := sum(n * k for n, k in fill)), -c, total, fill) for c in capacities if c >= first for fill in [_filled(first, c, there, count)]), key=lambda x: x[:2])
        for n, k in chosen:
            for _ in range(k):
                place[held[n].pop()] = len(shrunk)
            count[n] -= k
            if not count[n]:
                there &= ~(1 << n)
        shrunk.append(next(x for x in capacities if x >= used))
    return place, shrunk


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, capacity, doc_id, part, start, end, tokens) of every text of ``docs`` (id, text).

    A text is divided only if it alone exceeds the largest capacity; ``start`` and ``end`` (from 0) bound its part.
    Sizes, not texts, are shuffled: items are dealt by hash to shards of about ``SHARD_ITEMS``, each packed by
    ``best_fit``. Null and empty texts need no room and give no row; repeated ids are items of their own.
    """
    items = stage(spread(docs.select("id", "text")).select(F.col("id").alias("doc_id"), F.posexplode(parts_of("text", max(capacities), vocabulary)).alias("part", "p")).select("doc_id", (F.col("part") + 1).alias("part"), "p.start", "p.end", "p.tokens")).frame
    shards = max(1, -(-items.count() // SHARD_ITEMS))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "part", "start"])
        place, capacity = best_fit(rows["tokens"].tolist(), capacities)
        rows["container_id"] = [int(s) << 24 | c for s, c in zip(rows["shard"], place)]
        rows["capacity"] = [capacity[c] for c in place]
        return rows[["container_id", "capacity", "doc_id", "part", "start", "end", "tokens"]]

    return items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", "start"), F.lit(shards))).groupBy("shard").applyInPandas(packed, "container_id long, capacity int, doc_id long, part int, start int, end int, tokens int")


def containers(packed: DataFrame) -> DataFrame:
    """One row per container: capacity, tokens, unused and its items in order."""
    item = F.struct("doc_id", "part", "start", "end", "tokens")
    rows = packed.groupBy("container_id", "capacity").agg(F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(item)).alias("items"))
    return rows.select("container_id", "capacity", "tokens", (F.col("capacity") - F.col("tokens")).alias("unused"), "items")


def packed_texts(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """``packed`` with the text of each part. ``docs`` (id, text) must have unique ids here; the texts are shuffled once, by id."""
    part = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return packed.join(docs.select(F.col("id").alias("doc_id"), "text"), "doc_id").select("container_id", "capacity", "doc_id", "part", "tokens", part.alias("text"))
