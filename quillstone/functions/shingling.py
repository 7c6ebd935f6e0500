"""Word-run fingerprints of whole batches of texts, in NumPy.

Words are maximal runs of letters, digits and underscore of the case-folded text. A document's
set holds a 64-bit fingerprint of every run of ``k`` consecutive words, or of all words as one if
there are fewer. All texts of a chunk are hashed together: prefix sums of a polynomial hash over
code points give each word's value, the same over words gives each run's.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np

CHUNK_CHARS = 1 << 19
_BASE, _RUN_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@functools.lru_cache(1)
def _word_table() -> np.ndarray:
    return np.fromiter(((c := chr(i)).isalnum() or c == "_" for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


@functools.lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    with np.errstate(over="ignore"):
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ceil_size(n: int) -> int:
    return 1 << max(12, (n - 1).bit_length())


def _run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[s:e] for each s, e."""
    p, inv = _powers(base, _ceil_size(len(values) + 1))
    h = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * p[: len(values)], out=h[1:])
    return (h[ends] - h[starts]) * inv[starts]


def _chunk(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    folded = [t.casefold() for t in texts]
    codes = np.frombuffer("\n".join([*folded, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends_of_text = np.cumsum([len(t) + 1 for t in folded])
    flag = np.zeros(len(codes) + 2, dtype=np.int8)
    flag[1:-1] = _word_table()[codes]
    step = np.diff(flag)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    words = mix(_run_hashes(codes.astype(np.uint64) + np.uint64(1), starts, ends, _BASE) + (ends - starts).astype(np.uint64))
    upto = np.searchsorted(starts, ends_of_text, side="left")  # words before each text's end
    first = np.concatenate(([0], upto[:-1]))
    n = upto - first
    runs = np.maximum(n - k + 1, 1)
    offset = np.cumsum(runs) - runs
    at = np.arange(int(runs.sum())) - np.repeat(offset, runs) + np.repeat(first, runs)
    till = np.minimum(at + k, np.repeat(upto, runs))
    hashes = mix(_run_hashes(words, at, till, _RUN_BASE) + (till - at).astype(np.uint64))
    return hashes, runs


def fingerprints(texts: list[str], k: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, fingerprints of all runs in order, runs per text) chunk by chunk."""
    begin, size = 0, 0
    with np.errstate(over="ignore"):
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK_CHARS or i == len(texts) - 1:
                hashes, runs = _chunk(texts[begin : i + 1], k)
                yield begin, hashes, runs
                begin, size = i + 1, 0


def distinct_sets(hashes: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct fingerprints in ascending order: (text index, fingerprint, set sizes)."""
    doc = np.repeat(np.arange(len(runs)), runs)
    h = hashes.copy()
    end = np.cumsum(runs)
    for a, b in zip((end - runs).tolist(), end.tolist()):  # a text's runs lie together, and short sorts are fast
        h[a:b].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    d, h = doc[keep], h[keep]
    return d, h, np.bincount(d, minlength=len(runs))


def shingle_set(text: str, k: int = 5) -> set[tuple[str, ...]]:
    """One text's set of word runs, plainly; what the fingerprints stand for."""
    folded, table = text.casefold(), _word_table()
    words = "".join(c if table[ord(c)] else " " for c in folded).split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
