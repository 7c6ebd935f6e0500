"""Minimum-hash signatures and a banded index over them: a probabilistic search, beside the exact one of ``similarity``.

A signature has the minimum of a document's run fingerprints under ``HASHES`` hash functions. Its bands of ``ROWS`` minima are the
keys of the index; two documents that share a key are candidates, and are verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.shingling import distinct_sets, fingerprints, mix
from quillstone.operators.similarity import verify
from quillstone.session import spread
from quillstone.staging import stage

HASHES, ROWS, SEED = 128, 8, 42


def _seeds(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def signatures(docs: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """(id, class_id, signature): ``class_id`` tells equal sets of runs, ``signature`` has ``HASHES`` minima. Null texts count as empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(seed)
        for batch in batches:
            ids, texts = batch["id"].to_numpy(zero_copy_only=False), [x or "" for x in batch["text"].to_pylist()]
            for begin, hashes, runs in fingerprints(texts, k):
                _, h, n = distinct_sets(hashes, runs)
                start = np.cumsum(n) - n
                with np.errstate(over="ignore"):
                    minima = np.stack([np.minimum.reduceat(mix(h ^ s), start) for s in seeds], axis=1)
                    cls = mix(np.add.reduceat(mix(h), start) ^ n.astype(np.uint64))
                offsets = pa.array(np.arange(0, minima.size + 1, HASHES, dtype=np.int32))
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[begin : begin + len(n)]), "class_id": pa.array(cls.view(np.int64)), "signature": pa.ListArray.from_arrays(offsets, pa.array(minima.view(np.int64).ravel()))})

    return spread(docs.select("id", "text")).mapInArrow(sign, "id long, class_id long, signature array<long>")


def band_keys(signed: DataFrame) -> DataFrame:
    """(id, key): a row per band of each signature."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda b: F.xxhash64(b, F.slice("signature", b * ROWS + 1, F.lit(ROWS))))
    return signed.select("id", F.explode(bands).alias("key"))


def search(docs: DataFrame, asked: DataFrame, t: float = 0.8, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity): for each class of equal documents that has one among ``asked`` (id), the other classes with similarity t or more.

    Classes go by their smallest id, and (id, rep) of all documents is the second result, so copies are not expanded. Every
    document is in the index; a pair at similarity 0.8 is found with a chance of 0.94, at 0.9 of 0.9999. Null ids in ``asked`` ask nothing.
    """
    signed = stage(signatures(docs, k)).frame
    reps = signed.groupBy("class_id").agg(F.min("id").alias("rep"), F.min_by("signature", "id").alias("signature"))
    classes = stage(reps).frame
    members = signed.select("id", "class_id").join(classes.select("class_id", "rep"), "class_id").select("id", "rep")
    index = stage(band_keys(classes.select(F.col("rep").alias("id"), "signature"))).frame
    wanted = members.join(asked.select("id").distinct(), "id", "left_semi").select(F.col("rep").alias("id")).distinct()
    queries = index.join(wanted, "id", "left_semi").select(F.col("id").alias("q"), "key")
    met = stage(queries.join(index, "key").where("q <> id").select(F.col("q"), F.col("id").alias("m")).distinct()).frame
    pairs = met.select(F.least("q", "m").alias("a"), F.greatest("q", "m").alias("b")).distinct()
    sure = verify(pairs, docs, t, k).select(F.col("a").alias("lo"), F.col("b").alias("hi"), "similarity")
    found = met.withColumns({"lo": F.least("q", "m"), "hi": F.greatest("q", "m")}).join(sure, ["lo", "hi"])
    return found.select(F.col("q").alias("a"), F.col("m").alias("b"), "similarity"), members
