"""Splitting oversized items at natural boundaries, with overlap between consecutive pieces."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

_SENTENCE = re.compile(r"(?s).*[.!?][ \t\r\n]")
_SPACE = re.compile(r"(?s).*[ \t\r\n]")
_WORD = re.compile(r"[^\W_]+")
_BLANK = " \t\r"


def _paragraph_end(t: str, lo: int, hi: int) -> int:
    """Largest e in (lo, hi] directly after a paragraph break, or 0."""
    j = t.rfind("\n", lo, hi)
    while j > 0:
        k = j - 1
        while k >= 0 and t[k] in _BLANK:
            k -= 1
        if k >= 0 and t[k] == "\n":
            return j + 1
        j = t.rfind("\n", lo, j)
    return 0


def latest_boundary(t: str, lo: int, hi: int) -> int:
    """The largest cut in (lo, hi]: after a paragraph break, else a sentence end, else white space, else ``hi``."""
    if e := _paragraph_end(t, lo, hi):
        return e
    if m := _SENTENCE.match(t, lo - 1, hi):
        return m.end()
    if m := _SPACE.match(t, lo, hi):
        return m.end()
    return hi


def valley_depths(sims: list[float]) -> list[float]:
    """How far each similarity lies below the peaks next to it: from a place the peak on a side is reached by climbing as
    long as similarity does not fall."""
    out = []
    for i, s in enumerate(sims):
        left = right = s
        for x in reversed(sims[:i]):
            if x < left:
                break
            left = x
        for x in sims[i + 1 :]:
            if x < right:
                break
            right = x
        out.append(left + right - 2 * s)
    return out


def cohesion_boundary(t: str, lo: int, hi: int, block: int = 40) -> int:
    """The cut in (lo, hi] at the deepest valley of lexical cohesion; without two sentence ends as ``latest_boundary``.

    Cohesion at a sentence end is the cosine of the counts of the ``block`` words before and after it; blocks may reach
    beyond the window. Depth is measured from the peaks next to a valley, also those outside the window by one sentence
    end. Ties go to the later cut.
    """
    reach = 12 * block
    begin, stop = max(1, lo - reach), min(len(t), hi + reach)
    ends = [i + 1 for i in range(begin, stop) if t[i] in " \t\r\n" and t[i - 1] in ".!?\n"]
    inside = [e for e in ends if lo < e <= hi]
    if len(inside) < 2:
        return latest_boundary(t, lo, hi)
    near = [e for e in ends if e <= lo][-1:] + inside + [e for e in ends if e > hi][:1]
    base = max(0, near[0] - reach)
    spans = [(m.start() + base, m.group()) for m in _WORD.finditer(t[base : near[-1] + reach].lower())]
    starts, words = [x for x, _ in spans], [w for _, w in spans]
    sims = []
    for e in near:
        i = bisect_left(starts, e)
        a, b = Counter(words[max(0, i - block) : i]), Counter(words[i : i + block])
        norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        sims.append(sum(v * b[w] for w, v in a.items()) / norm if norm else 0.0)
    return max((d, e) for d, e in zip(valley_depths(sims), near, strict=True) if lo < e <= hi)[1]


def pieces(t: str, limit: int, overlap: int, least: int, boundary=latest_boundary) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text longer than ``limit``."""
    out, s, n = [], 0, len(t)
    while n - s > limit:
        e = boundary(t, s + least, s + limit)
        out.append((s, e))
        s = e - overlap
    out.append((s, n))
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 1000, overlap: int = 100, least: int = 500, boundary: str = "latest") -> DataFrame:
    """Pieces of every text longer than ``limit`` code points: ``key``, piece_no (from 1), start_char, end_char.

    A piece ends more than ``least`` and at most ``limit`` after its start, at the cut ``boundary`` chooses: 'latest' is
    the last natural boundary of the best kind, 'cohesion' the deepest valley of lexical cohesion. The next piece starts
    ``overlap`` before. Null, empty and shorter texts give no rows; repeated rows count once. The text does not leave
    the scan's task; only the short piece rows are shuffled to drop repeats.
    """
    if not 0 <= overlap <= least < limit:
        raise ValueError("needs 0 <= overlap <= least < limit")
    rule = {"latest": latest_boundary, "cohesion": cohesion_boundary}[boundary]

    def cut(batches):
        for b in batches:
            keys, no, start, end = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, (s, e) in enumerate(pieces(t, limit, overlap, least, rule), 1):
                    keys.append(k), no.append(i), start.append(s), end.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["k", "piece_no", "start_char", "end_char"])

    ship(df.sparkSession)
    src = df.where(F.length(text) > limit).select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = src.mapInArrow(cut, f"k {dict(src.dtypes)['k']}, piece_no int, start_char int, end_char int")
    return out.withColumnRenamed("k", key).distinct()
