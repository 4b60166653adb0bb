"""Operators that need order or structure within a key: spans, batches, regions, alias matching and resampling."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import ranked
from lodestone.session import cut, ship, small


def alias_normalise(terms: DataFrame, term: str, names: DataFrame, alias: str, canonical: str, ratio: float = 0.85) -> DataFrame:
    """Add ``normal``: canonical name of the exact alias, else of the longest contained alias, else of the closest alias
    within the edit ratio, else the term itself. ``terms`` must be distinct; null terms stay null.

    ``names`` is a dictionary; it is broadcast if its estimated size allows, and each term keeps one row throughout.
    """
    n = names.select(F.col(alias).alias("__a"), F.col(canonical).alias("__c")).distinct()
    close = 1 - F.levenshtein(F.col(term), F.col("__a")) / F.greatest(F.length(term), F.length("__a"), F.lit(1))
    score = F.when(F.col(term) == F.col("__a"), F.lit(3e6)).when(F.col(term).contains(F.col("__a")), 1e6 + F.length("__a")).when(close >= ratio, close).otherwise(F.lit(0.0))
    hits = terms.join(small(n), score > 0, "left").withColumn("__s", F.when(F.col("__a").isNotNull(), score))
    keys = terms.columns
    best = hits.groupBy(*keys).agg(F.max(F.struct(F.coalesce("__s", F.lit(0.0)), F.col("__c"))).alias("b"))
    return best.select(*keys, F.coalesce("b.__c", F.col(term)).alias("normal"))


#: Kinds of spans, their patterns and how sure each is; a number with its unit is surer than the number or the unit alone.
SPAN_KINDS = (("measurement", re.compile(r"\d+(?:[.,]\d+)*\s?(?:J/mm3|MPa|GPa|kHz|nm|µm|mm/s|W|K|%|HV)(?![A-Za-z])"), 0.9), ("number", re.compile(r"\d+(?:[.,]\d+)*"), 0.6), ("alloy", re.compile(r"(?:[A-Z][a-z]?\d+(?:\.\d+)?){2,}"), 0.8), ("range", re.compile(r"\d+(?:[.,]\d+)* (?:and|to) \d+(?:[.,]\d+)*"), 0.7))


def deduplicated_spans(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of spans (start, stop, kind, confidence) sorted by start, the longest first, those that overlap none before them; a
    surer one that overlaps the last replaces it."""
    out: list[tuple[int, int, str, float]] = []
    end = -1
    for x in sorted(spans, key=lambda s: (s[0], s[0] - s[1], s[2])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
        elif x[3] > out[-1][3]:
            out[-1] = x
    return out


def entity_spans(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, stop, kind, confidence) of the spans that remain of all overlapping candidates. One narrow pass."""
    ship(pages.sparkSession)

    def spans(frames):
        for f in frames:
            out = []
            for k, t in zip(f["k"], f["t"], strict=True):
                found = [(m.start(), m.end(), kind, sure) for kind, pattern, sure in SPAN_KINDS for m in pattern.finditer(t)]
                out += [(k, *x) for x in deduplicated_spans(found)]
            yield pd.DataFrame(out, columns=["key", "start", "stop", "kind", "confidence"])

    src = pages.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInPandas(spans, f"key {dict(src.dtypes)['k']}, start int, stop int, kind string, confidence double").withColumnRenamed("key", key)


#: Words that name a property and a process (reference), and the written forms of a quantity.
PROPERTY_WORDS = "strength hardness modulus conductivity energy coefficient threshold density viscosity absorptivity reflectivity stress".split()
PROCESS_WORDS = "ablation melting solidification annealing aging sintering deposition etching polishing".split()
_QUANTITY = re.compile(r"(?<![\w.,])(\d+(?:[.,]\d+)*)\s?(mm/s|J/mm3|MPa|GPa|kHz|MHz|kW|mW|nm|µm|ns|fs|ps|W|K|%|HV)(?![A-Za-z0-9])")
#: A stop inside a number ends no sentence.
_STOP = re.compile(r"[.!?]+(?=\s|$)")
#: Relation: types of subject and object, distance they stay below in characters, confidence.
RELATIONS = {"has_property": ("material", "property", 100, 0.7), "affects": ("process", "material", 150, 0.65), "measured_as": ("property", "quantity", 80, 0.8)}


def _any_of(words: list[str]) -> re.Pattern:
    forms = [r"\s+".join(map(re.escape, w.split())) for w in sorted(words, key=lambda w: (-len(w), w))]
    return re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])", re.I)


def sentence_relations(pages: DataFrame, key: str, text: str, materials: dict[str, str]) -> DataFrame:
    """(key, sentence, subject, predicate, object, confidence, subject_at, object_at): a row for each pair of mentions of one
    sentence whose starts lie closer than their relation's limit. ``materials``: canonical names by written form, a fixed
    dimension. All mentions of a sentence take part; one narrow pass, as no pair crosses a sentence."""
    canonical = {" ".join(k.lower().split()): v for k, v in materials.items()}
    words = {t: _any_of(w) for t, w in (("material", list(canonical)), ("property", PROPERTY_WORDS), ("process", PROCESS_WORDS)) if w}

    def relate(frames):
        for f in frames:
            out = []
            for k, t in zip(f["k"], f["t"], strict=True):
                stops = [m.end() for m in _STOP.finditer(t)]
                said: dict[tuple[int, str], list[tuple[int, str]]] = {}
                for kind, pattern in words.items():
                    for m in pattern.finditer(t):
                        name = " ".join(m.group().lower().split())
                        said.setdefault((bisect_left(stops, m.end()), kind), []).append((m.start(), canonical[name] if kind == "material" else name))
                for m in _QUANTITY.finditer(t):
                    said.setdefault((bisect_left(stops, m.end()), "quantity"), []).append((m.start(), m[1] + m[2]))
                for n in sorted({n for n, _ in said}):
                    for relation, (a, b, limit, sure) in RELATIONS.items():
                        objects = said.get((n, b), [])
                        for at, subject in said.get((n, a), []):
                            for o in objects[bisect_left(objects, (at - limit + 1,)) : bisect_left(objects, (at + limit,))]:
                                out.append((k, n, subject, relation, o[1], sure, at + 1, o[0] + 1))
            yield pd.DataFrame(out, columns=["key", "sentence", "subject", "predicate", "object", "confidence", "subject_at", "object_at"])

    src = pages.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    return src.mapInPandas(relate, f"key {dict(src.dtypes)['k']}, sentence int, subject string, predicate string, object string, confidence double, subject_at int, object_at int").withColumnRenamed("key", key)


class _Block:
    """A block of items to be packed: what becomes of any fill that an open batch brings into it."""

    def __init__(self, sizes: np.ndarray, limit: int):
        self.sizes, self.limit = sizes, limit
        self.sums = np.concatenate([[0], np.cumsum(sizes)])
        m = len(sizes)
        # the batch that begins at i ends before after[i]; at least one item belongs to it
        after = np.maximum(np.searchsorted(self.sums, self.sums[:-1] + limit, side="right") - 1, np.arange(m) + 1)
        self.after, self.count, self.last = after, np.zeros(m, np.int64), np.zeros(m, np.int64)
        for i in range(m - 1, -1, -1):
            n = after[i]
            self.count[i], self.last[i] = (1, i) if n >= m else (self.count[n] + 1, self.last[n])

    def first_break(self, items: int, fill: int) -> int:
        """Index of the first item that an open batch of ``items`` items and ``fill`` cannot take."""
        n = int(np.searchsorted(self.sums, self.limit - fill, side="right") - 1)
        return max(n, 1) if not items else max(n, 0)

    def summary(self) -> tuple:
        """Sums, batches begun and fill left open, by the first break; only breaks that a fill can bring about are listed."""
        m = len(self.sizes)
        n = min(int(np.searchsorted(self.sums, self.limit, side="right")) + 1, m)
        return self.sums[: n + 1].tolist(), self.count[:n].tolist(), (m - self.last[:n]).tolist(), (self.sums[-1] - self.sums[self.last[:n]]).tolist(), m, int(self.sums[-1])


def greedy_batches(df: DataFrame, key: str, order: str, size: Column, limit: int, block: int = 5000) -> DataFrame:
    """(key, batch, items, chars): items packed in order into batches of at most ``limit``; a longer item is a batch alone.

    The items of a key are ranked by range blocks and cut into blocks of ``block`` places. Each block is summed up by where
    an open batch first breaks in it, the summaries are followed from block to block, and the blocks are then packed
    apart: the batches are those of one pass over the key, whatever its size. Equal orders are packed by size. A null
    key is one key; null sizes count as 0.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.coalesce(size.cast("long"), F.lit(0)).alias("s"))
    r = ranked(rows, ["k"], [F.col("o"), F.col("s")], "r").withColumn("b", F.floor((F.col("r") - 1) / block))
    r = cut(r.groupBy("k", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x["s"]).alias("sizes")))
    kt = dict(r.dtypes)["k"]

    def summarise(frames):
        for f in frames:
            out = [(k, b, *_Block(np.asarray(s, np.int64), limit).summary()) for k, b, s in zip(f["k"], f["b"], f["sizes"], strict=True)]
            yield pd.DataFrame(out, columns=["k", "b", "sums", "count", "items", "fill", "m", "total"])

    summaries = r.mapInPandas(summarise, f"k {kt}, b long, sums array<long>, count array<long>, items array<long>, fill array<long>, m long, total long")

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        out, batch, items, fill = [], 0, 0, 0
        for x in pdf.sort_values("b").itertuples(index=False):
            out.append((x.k, x.b, batch, items, fill))
            sums = np.asarray(x.sums)
            n = int(np.searchsorted(sums, limit - fill, side="right") - 1)
            n = max(n, 0 if items else 1)
            if n >= x.m:
                items, fill = items + x.m, fill + x.total
            else:
                batch, items, fill = batch + int(x.count[n]), int(x.items[n]), int(x.fill[n])
        return pd.DataFrame(out, columns=["k", "b", "batch", "items", "fill"])

    starts = summaries.groupBy("k").applyInPandas(follow, f"k {kt}, b long, batch long, items long, fill long")

    def pack(frames):
        for f in frames:
            out = []
            for k, sizes, batch, items, fill in zip(f["k"], f["sizes"], f["batch"], f["items"], f["fill"], strict=True):
                b = _Block(np.asarray(sizes, np.int64), limit)
                n = min(b.first_break(items, fill), len(b.sizes))
                if n:
                    out.append((k, batch, n, int(b.sums[n])))
                while n < len(b.sizes):
                    batch, stop = batch + 1, min(int(b.after[n]), len(b.sizes))
                    out.append((k, batch, stop - n, int(b.sums[stop] - b.sums[n])))
                    n = stop
            yield pd.DataFrame(out, columns=["key", "batch", "items", "chars"])

    j = r.join(starts.withColumnsRenamed({"k": "k2", "b": "b2"}), F.col("k").eqNullSafe(F.col("k2")) & (F.col("b") == F.col("b2"))).select("k", "sizes", "batch", "items", "fill")
    packed = j.mapInPandas(pack, f"key {kt}, batch long, items long, chars long")
    return packed.groupBy("key", "batch").agg(F.sum("items").alias("items"), F.sum("chars").alias("chars")).withColumnRenamed("key", key)


def region_statistics(cells: DataFrame) -> DataFrame:
    """(field, regions, mean_area, max_area, fraction) of the 8-connected regions of cells (field, row, col, on).

    A field is one image, which fits a task.
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        on = {(r, c) for r, c, v in pdf[["row", "col", "on"]].itertuples(index=False) if v}
        areas, left = [], set(on)
        while left:
            stack, area = [left.pop()], 0
            while stack:
                r, c = stack.pop()
                area += 1
                for q in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if q in left:
                        left.remove(q)
                        stack.append(q)
            areas.append(area)
        return pd.DataFrame({"field": [pdf["field"].iloc[0]], "regions": [len(areas)], "mean_area": [float(np.mean(areas)) if areas else 0.0], "max_area": [max(areas, default=0)], "fraction": [len(on) / len(pdf)]})

    return cells.groupBy("field").applyInPandas(label, "field string, regions int, mean_area double, max_area int, fraction double")


def bootstrap_mean(df: DataFrame, key: str, value: str, rounds: int) -> DataFrame:
    """(lo, mean, hi): 95 % percentile interval of the mean. Poisson weights are derived from the row's key and the round,
    so each task sums its rows' weights per round and only those sums are shuffled."""

    def resample(frames):
        w, s = np.zeros(rounds), np.zeros(rounds)
        for f in frames:
            for k, v in zip(f["k"], f["v"], strict=True):
                n = np.random.default_rng(int(k) & 0x7FFFFFFF).poisson(1.0, rounds)
                w += n
                s += n * v
        yield pd.DataFrame({"round": np.arange(rounds), "w": w, "s": s})

    sums = df.select(F.col(key).alias("k"), F.col(value).alias("v")).mapInPandas(resample, "round int, w double, s double")
    means = sums.groupBy("round").agg((F.sum("s") / F.sum("w")).alias("m"))
    return means.agg(F.round(F.percentile("m", 0.025), 6).alias("lo"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.percentile("m", 0.975), 6).alias("hi"))
