"""Token counts under a public tokenizer, each distinct piece being tokenized once."""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import spread

#: The vocabulary (ranks of byte pairs) and the pattern that belongs to it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space with the word after it, or at the end: no token of the pattern reaches over such a piece.
_PIECE = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: Entries a worker keeps before it starts anew or sends what it has.
KEPT = 400_000

_ENCODERS: dict = {}


def encoder(vocabulary: str = VOCABULARY):
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def clean(text: str) -> str:
    """Lone surrogates can't be encoded; they count as the replacement character."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def pieces(text: str) -> list[str]:
    return _PIECE.findall(text)


def count_tokens(text: str, enc, kept: dict[str, int]) -> int:
    total = 0
    for p in pieces(text):
        n = kept.get(p)
        if n is None:
            n = len(enc.encode_ordinary(clean(p)))
            if len(kept) >= KEPT:
                kept.clear()
            kept[p] = n
        total += n
    return total


def tokens_of(column: str, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of each text; 0 where it is null or empty."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        enc, kept = encoder(vocabulary), _KEPT.setdefault(vocabulary, {})
        return pa.array([count_tokens(x, enc, kept) if x else 0 for x in texts.to_pylist()], pa.int64())

    return counted(F.col(column))


_KEPT: dict[str, dict[str, int]] = {}


def token_totals(docs: DataFrame, by: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """Documents, characters and exact tokens of ``text`` per slice ``by`` (string columns; null is a slice of its own).

    Tasks split their texts into pieces and count them per slice; the piece frequencies of all tasks are added
    up and sorted by piece, each distinct piece is tokenized once, and its length merged with its frequencies. Null and
    empty texts count as documents without tokens; an empty table has no slices; other columns are ignored.
    """
    schema = ", ".join(f"`{c}` string" for c in by)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[tuple, Counter] = {}
        held = 0
        for batch in batches:
            for key, text in zip(zip(*(batch[c].to_pylist() for c in by)), batch["text"].to_pylist()):
                if text:
                    counter = slices.setdefault(key, Counter())
                    before = len(counter)
                    counter.update(pieces(text))
                    held += len(counter) - before
            if held > KEPT:
                yield _rows(slices)
                slices, held = {}, 0
        if slices:
            yield _rows(slices)

    def _rows(slices: dict[tuple, Counter]) -> pa.RecordBatch:
        keys = [k for k, c in slices.items() for _ in range(len(c))]
        out = {name: pa.array([k[i] for k in keys], pa.string()) for i, name in enumerate(by)}
        out["piece"] = pa.array([clean(p) for c in slices.values() for p in c], pa.string())
        out["n"] = pa.array([n for c in slices.values() for n in c.values()], pa.int64())
        return pa.RecordBatch.from_pydict(out)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums per slice over pieces in order, so each is tokenized once and its length meets all its frequencies."""
        enc, last, length = encoder(vocabulary), None, 0
        sums: dict[tuple, list[int]] = {}
        for batch in batches:
            for key, piece, n in zip(zip(*(batch[c].to_pylist() for c in by)), batch["piece"].to_pylist(), batch["n"].to_pylist()):
                if piece != last:
                    last, length = piece, len(enc.encode_ordinary(piece))
                held = sums.setdefault(key, [0, 0])
                held[0] += n
                held[1] += n * length
        out = {name: pa.array([k[i] for k in sums], pa.string()) for i, name in enumerate(by)}
        yield pa.RecordBatch.from_pydict(out | {"pieces": pa.array([v[0] for v in sums.values()], pa.int64()), "tokens": pa.array([v[1] for v in sums.values()], pa.int64())})

    freq = spread(docs.select(*by, "text")).mapInArrow(frequencies, f"{schema}, piece string, n long").repartition("piece").groupBy("piece", *by).agg(F.sum("n").alias("n"))
    per_task = freq.sortWithinPartitions("piece").mapInArrow(summed, f"{schema}, pieces long, tokens long")
    totals = per_task.groupBy(*by).agg(F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"))
    counts = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("characters"))
    same = [counts[c].eqNullSafe(totals[c]) for c in by]
    return counts.join(totals, same, "left").select(*[counts[c] for c in by], "documents", "characters", F.coalesce("pieces", F.lit(0)).alias("pieces"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
