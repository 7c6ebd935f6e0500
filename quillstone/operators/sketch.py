"""Fixed-size counting sketches: per-task dense arrays, merged by chunk, small enough to broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Entries of a row that a task sends; the rows of each chunk are added up by one task.
CHUNK = 1 << 14
PORTION = 1 << 22
#: Tasks a core that count, whatever the number of input splits: what is sent grows with the cluster, not with the data.
TASKS = 4
CHUNKS = "chunk int, counts binary"


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


class Counter:
    """One task's counts, taken in portions, as each count walks over all buckets."""

    def __init__(self, bits: int):
        self.bits, self.held = bits, 0
        self.counts = np.zeros(1 << bits, dtype=np.uint32)
        self.waiting: list[np.ndarray] = []

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(bucket(hashes, self.bits))
        self.held += len(hashes)
        if self.held >= PORTION:
            self._count()

    def _count(self) -> None:
        if self.waiting:
            np.add(self.counts, np.bincount(np.concatenate(self.waiting), minlength=1 << self.bits), out=self.counts, casting="unsafe")
            self.waiting, self.held = [], 0

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        """Number and counts of every chunk, a byte each where that is enough."""
        self._count()
        for i in range(0, 1 << self.bits, CHUNK):
            part = self.counts[i : i + CHUNK]
            if (most := part.max()):
                yield i // CHUNK, (part.astype(np.uint8) if most < 256 else part).tobytes()


def few_tasks(df: DataFrame) -> DataFrame:
    """``df`` read by ``TASKS`` tasks a core at most, without a shuffle."""
    return df.coalesce(TASKS * df.sparkSession.sparkContext.defaultParallelism)


def merged_sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """The sum of the chunks that tasks sent, on a logarithmic scale; it has 2**bits entries whatever the input's size."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist()):
                part = np.frombuffer(raw, dtype=np.uint8 if len(raw) < 4 * CHUNK else np.uint32).astype(np.uint64)
                sums[c] = sums[c] + part if c in sums else part
        for c, s in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "counts": pa.array([_squash(s).tobytes()], pa.binary())})

    out = np.zeros(1 << bits, dtype=np.uint16)
    for r in rows.select("chunk", "counts").repartition("chunk").mapInArrow(merged, CHUNKS).collect():
        part = np.frombuffer(r["counts"], dtype=np.uint16)
        out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(part)] = part
    return out


def count_sketch(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """Occurrences of 64-bit hashes per bucket (the top ``bits`` bits), over all rows of ``df``.

    Every task counts into one array of 2**bits integers; tasks send it in chunks, which are added up as they stream in.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(bits)
        for batch in batches:
            for h in hashes(batch):
                counter.add(h)
        for chunk, counts in counter.chunks():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([counts], pa.binary())})

    return merged_sketch(few_tasks(df).mapInArrow(local, CHUNKS), bits)


def _squash(counts: np.ndarray) -> np.ndarray:
    """Counts of any size on a logarithmic scale of 16 bits; order is kept, 0 stays 0."""
    return np.minimum(np.ceil(np.log2(1.0 + counts) * 1400), 65535).astype(np.uint16)


def decoded(levels: np.ndarray) -> np.ndarray:
    """Counts behind the sketch's logarithmic scale, never less than they were."""
    return np.ceil(np.exp2(levels / 1400.0) - 1.0)


def sketch_counts(sketch: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """About how often each hash was counted, never less than it was."""
    return decoded(sketch[bucket(hashes, len(sketch).bit_length() - 1)])
