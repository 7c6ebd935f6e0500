"""Splitting oversized texts at natural boundaries by recursive bisection, with overlaps."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import spread

LEVELS = ("paragraph", "line", "sentence", "word", "hard")
_SENTENCE = re.compile(r"[.!?](?=\s)\s*")
_SPACES = re.compile(r"\s+")
PLAN = "struct<boundary:string,pieces:array<struct<start:int,end:int,overlap:int>>>"


class _Text:
    """Where a text (line ends read as \\n) may be cut, level by level, found when first asked for."""

    def __init__(self, text: str, limit: int):
        self.text, self.limit = text, limit
        self.lines: list[tuple[int, int, bool]] = []
        at = 0
        for line in text.split("\n"):
            self.lines.append((at, at + len(line), not line.strip()))
            at += len(line) + 1
        self.runs: list[tuple[int, int]] = []
        fresh = True
        for s, e, blank in self.lines:
            if not blank:
                if fresh:
                    self.runs.append((s, e))
                else:
                    self.runs[-1] = (self.runs[-1][0], e)
            fresh = blank
        self._points: dict[int, tuple[list[int], list[int]]] = {}

    def boundary(self) -> int:
        """The first level whose units all keep the limit."""
        if all(e - s <= self.limit for s, e in self.runs):
            return 0
        long = [(s, e) for s, e, blank in self.lines if e - s > self.limit and not blank]
        if not long:
            return 1
        stretches = [p for s, e in long for p in self._stretches(s, e)]
        long = [(s, e) for s, e in stretches if e - s > self.limit]
        if not long:
            return 2
        return 3 if all(len(w) <= self.limit for s, e in long for w in self.text[s:e].split()) else 4

    def _stretches(self, s: int, e: int) -> list[tuple[int, int]]:
        out, at = [], s
        for m in _SENTENCE.finditer(self.text, s, e):
            out.append((at, m.start() + 1))
            at = m.end()
        return [*out, (at, e)]

    def points(self, level: int) -> tuple[list[int], list[int]]:
        """Cuts before a unit's start, and those behind its end, which serve where the former don't."""
        if level not in self._points:
            if level == 0:
                starts, ends = [s for s, _ in self.runs], [e for _, e in self.runs]
                gaps = zip([0, *ends], [*starts, len(self.text)])
                inside = [p for a, b in gaps if b - a > self.limit // 4 for p in range(a, b, self.limit // 8 or 1)]
                ends = sorted(ends + inside)
            elif level == 1:
                starts, ends = [s for s, _, blank in self.lines if not blank], [e for _, e, _ in self.lines]
            elif level == 2:
                found = [(m.start() + 1, m.end()) for m in _SENTENCE.finditer(self.text)]
                starts, ends = [b for _, b in found], [a for a, _ in found]
            else:
                found = [(m.start(), m.end()) for m in _SPACES.finditer(self.text)]
                starts, ends = [b for _, b in found], [a for a, _ in found]
            self._points[level] = starts, ends
        return self._points[level]

    def cut(self, s: int, e: int, weakest: int) -> int | None:
        """The point nearest the middle among those of the strongest level that has any in the middle half.

        Only ends of paragraphs, lines and sentences are held to that half; where it has none of them, the strongest level that has
        any point inside gives the cut, so that a word is not cut off for being nearer.
        """
        middle, quarter = (s + e) // 2, (e - s) // 4
        for low, high, least in ((s + quarter, e - quarter, 2), (s, e, 3)):
            for level in range(min(weakest, least) + 1):
                for points in self.points(level):
                    i, j = bisect_right(points, low), bisect_left(points, high)
                    if i < j:
                        k = bisect_left(points, middle, i, j)
                        return min(points[max(i, k - 1) : min(j, k + 1)], key=lambda p: abs(p - middle))
        return middle if weakest == 4 else None


def plan(text: str, limit: int, overlap: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text's boundary class, and its pieces as (start, end, overlap), start lying behind the overlap."""
    t = _Text(text, limit)
    level = t.boundary()
    cores, todo = [], [(0, len(text))]
    while todo:  # bisection, left half first
        s, e = todo.pop()
        at = None
        if e - s > limit - overlap:
            at = t.cut(s, e, level)
            if at is None and e - s > limit:
                at = t.cut(s, e, 4)
        if at is None:
            cores.append((s, e))
        else:
            todo += [(at, e), (s, at)]
    merged: list[tuple[int, int]] = []
    for s, e in cores:
        if merged and e - merged[-1][0] <= limit - overlap:
            merged[-1] = (merged[-1][0], e)
        else:
            merged.append((s, e))
    pieces = []
    for i, (s, e) in enumerate(merged):
        back = 0
        if i:
            earliest = max(s - min(overlap, limit - (e - s)), merged[i - 1][0])
            for lvl in (2, 3):
                starts = t.points(lvl)[0]
                k = bisect_left(starts, earliest)
                if k < len(starts) and starts[k] < s:
                    earliest = starts[k]
                    break
            back = s - earliest
        pieces.append((s, e, back))
    return LEVELS[level], pieces


def plan_pieces(docs: DataFrame, limit: int = 3000, overlap: int = 200) -> DataFrame:
    """``docs`` (id, text) with more than ``limit`` code points: id, text (line ends as \\n), boundary and pieces.

    A piece takes at most ``limit`` code points including up to ``overlap`` repeated from its predecessor's end;
    ``start`` and ``end`` (from 0) bound what is new in it. A segment is cut at the strongest boundary nearest
    its middle: between paragraphs, lines, sentences, words, and inside a word only where nothing else
    exists; neighbours that fit together are joined again. Null and short texts give no row.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")

    @F.arrow_udf(PLAN)
    def planned(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            boundary, pieces = plan(x, limit, overlap)
            out.append({"boundary": boundary, "pieces": [dict(zip(("start", "end", "overlap"), p)) for p in pieces]})
        piece = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("overlap", pa.int32())])
        return pa.array(out, pa.struct([("boundary", pa.string()), ("pieces", pa.list_(piece))]))

    long = spread(docs).where(F.length("text") > limit).select("id", F.replace("text", F.lit("\r\n"), F.lit("\n")).alias("text"))
    return long.withColumn("plan", planned("text")).select("id", "text", "plan.boundary", "plan.pieces")


def split_oversized(docs: DataFrame, limit: int = 3000, overlap: int = 200) -> DataFrame:
    """Ordered pieces of every text of ``docs``: id, piece (from 1), start, end, overlap, text.

    Texts within the limit are their own single piece; nulls give none. See ``plan_pieces``.
    """
    cut = plan_pieces(docs, limit, overlap).select("id", "text", F.posexplode("pieces").alias("at", "p"))
    first = F.col("p.start") - F.col("p.overlap")
    pieces = cut.select("id", (F.col("at") + 1).alias("piece"), "p.start", "p.end", "p.overlap", F.substring("text", first + 1, F.col("p.end") - first).alias("text"))
    whole = docs.where(F.length("text") <= limit).select("id", F.lit(1).alias("piece"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(0).alias("overlap"), "text")
    return pieces.unionByName(whole)
