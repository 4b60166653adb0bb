"""Best representative of each duplicate group, field by field, by token-level consensus.

The values of a group are aligned progressively into a profile; each column of the profile holds a weighted vote; the
existing value closest to the consensus survives. Profiles of blocks are merged level by level, so that a group of any
size is never gathered in one task.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut

#: Values aligned in one task; larger groups are aligned in blocks, whose profiles are then merged in rounds.
BLOCK = 64

#: Texts that stand for a missing value, lower-cased.
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "nan", "unknown", "not available", "not assigned", "pending", "tbd", "?", "no title", "(title)", "title", "untitled", "paper title here", "layout 1", "document1", "abstract", "no abstract available", "no abstract available.", "abstract not available", "abstract not available for this record.", "n.d.")


def is_placeholder(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))).isin(*PLACEHOLDERS)


def usable_title(c: Column) -> Column:
    """No placeholder, no file name and at least one letter."""
    t = F.trim(c)
    return ~is_placeholder(c) & ~t.rlike(r"(?i)^\S*\.(pdf|docx?|tex|indd|rtf|odt|txt|ps|eps|qxd|pptx?|xlsx?|html?|dvi|pages|md)$") & ~t.rlike(r"(?i)^(document|layout|untitled|presentation|manuscript|slide|microsoft word)[ _-]*\d*$") & t.rlike(r"\p{L}")


def usable_doi(c: Column) -> Column:
    """Prefix and suffix present, with or without a resolver address or a ``doi:`` label."""
    return F.coalesce(F.trim(c).rlike(r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi\.org/|doi:?\s*|info:doi/|urn:doi:)?10\.\d{4,9}/\S+$"), F.lit(False))


def usable_year(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(r"^\d{4}$") & F.trim(c).try_cast("int").between(1980, 2026), F.lit(False))


def usable_abstract(c: Column) -> Column:
    """No placeholder and not cut off: it ends as a sentence ends."""
    t = F.trim(c)
    return ~is_placeholder(c) & t.rlike(r"""[.!?]["'”’)]*$""") & ~t.rlike(r"(\.\.\.|…|\[\s*(\.\.\.|…)\s*\]|\bet al\.|\bFig\.)$")


class Profile:
    """Alignment of token lists: ``columns[i]`` maps a token (None: gap) to its vote; ``total`` is the vote of all."""

    def __init__(self, tokens: list[str], weight, combine):
        self.columns = [{t: weight} for t in tokens]
        self.total = weight
        self.combine = combine

    def merge(self, other: Profile) -> None:
        steps = align([self._keys(c) for c in self.columns], [self._keys(c) for c in other.columns])
        out = []
        for i, j in steps:
            a = self.columns[i] if i is not None else {None: self.total}
            b = other.columns[j] if j is not None else {None: other.total}
            for t, w in b.items():
                a[t] = self.combine(a[t], w) if t in a else w
            out.append(a)
        self.columns, self.total = out, self.combine(self.total, other.total)

    @staticmethod
    def _keys(column: dict) -> frozenset:
        return frozenset(t.casefold() for t in column if t is not None)

    def consensus(self) -> list[str]:
        best = (max(c.items(), key=lambda x: (x[1], x[0] or ""))[0] for c in self.columns)
        return [t for t in best if t is not None]


def align(a: list[frozenset], b: list[frozenset]) -> list[tuple[int | None, int | None]]:
    """Global alignment of two profiles' columns. Columns that agree at both ends are aligned in any best alignment, so only
    what lies between them is scored."""
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i].isdisjoint(b[i])), least)
    tail = next((i for i in range(least - head) if a[-1 - i].isdisjoint(b[-1 - i])), least - head)
    between = _align(a[head : len(a) - tail], b[head : len(b) - tail])
    shifted = [(None if i is None else i + head, None if j is None else j + head) for i, j in between]
    return [(i, i) for i in range(head)] + shifted + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]


def _align(a: list[frozenset], b: list[frozenset]) -> list[tuple[int | None, int | None]]:
    """Best alignment of two lists of columns; a row of scores is one vector operation."""
    n, m = len(a), len(b)
    if not n or not m:
        return [(i, None) for i in range(n)] + [(None, j) for j in range(m)]
    where: dict[str, list[int]] = {}
    for j, keys in enumerate(b):
        for k in keys:
            where.setdefault(k, []).append(j)
    slope = np.arange(m + 1, dtype=np.float64)
    score = -slope
    rows = [score]
    matched = []
    for i in range(n):
        hit = np.full(m, -1.5)
        for k in a[i]:
            if k in where:
                hit[where[k]] = 2.0
        matched.append(hit)
        best = np.empty(m + 1)
        best[0] = score[0] - 1
        np.maximum(score[:-1] + hit, score[1:] - 1, out=best[1:])
        score = np.maximum.accumulate(best + slope) - slope
        rows.append(score)
    out, i, j = [], n, m
    while i or j:
        if i and j and abs(rows[i][j] - (rows[i - 1][j - 1] + matched[i - 1][j - 1])) < 1e-9:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and abs(rows[i][j] - (rows[i - 1][j] - 1)) < 1e-9:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def token_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two token lists; each row is one vector operation."""
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return len(a) + len(b)
    codes = {t: i for i, t in enumerate(dict.fromkeys(a + b))}
    x, y = [codes[t] for t in a], np.array([codes[t] for t in b], np.int64)
    slope = np.arange(len(y) + 1)
    row = slope.copy()
    for i, t in enumerate(x, 1):
        best = np.empty(len(y) + 1, np.int64)
        best[0] = i
        np.minimum(row[:-1] + (y != t), row[1:] + 1, out=best[1:])
        row = np.minimum.accumulate(best - slope) + slope
    return int(row[-1])


def _larger(a, b):
    return max(a, b)


def _added(a, b):
    return (a[0] + b[0], max(a[1], b[1]))


def consensus_survivors(values: DataFrame, dominant: bool = True) -> DataFrame:
    """For each (g, field) of (g, field, row, value, trust): the row whose existing value is closest to the consensus.

    ``dominant`` weighs votes so that a row outvotes all rows of lower trust, or of equal trust and smaller row id,
    together; else a value's votes are the sum of its rows' trust. Among equally close values the more trusted, then
    the larger row id wins. Rows with null value must be left out before; a group without rows gives none. Equal values
    are pre-aggregated, blocks of at most about BLOCK values are aligned per task, and profiles are merged in rounds.
    """
    distinct = values.groupBy("g", "field", "value").agg(F.max(F.struct("trust", "row")).alias("top"), F.sum("trust").alias("votes"))
    sizes = distinct.groupBy("g", "field").agg(F.count(F.lit(1)).alias("n"))
    d = cut(distinct.join(sizes, ["g", "field"]).select("g", "field", "value", "n", "votes", F.col("top.trust").cast("double").alias("trust"), F.col("top.row").alias("row"), F.pmod(F.xxhash64("value"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block")))
    gtype, rtype = dict(d.dtypes)["g"], dict(d.dtypes)["row"]
    combine = _larger if dominant else _added

    def profile_of(found: list[dict]) -> Profile:
        profile = None
        for x in sorted(found, key=lambda x: (x["trust"], x["row"]), reverse=True):
            weight = (x["trust"], x["row"]) if dominant else (float(x["votes"]), (x["trust"], x["row"]))
            one = Profile(x["value"].split(), weight, combine)
            if profile is None:
                profile = one
            else:
                profile.merge(one)
        return profile

    def survivor(batches):
        """The row of each whole group."""
        for b in batches:
            rows = []
            for found in b.column(2).to_pylist():
                goal = profile_of(found).consensus()
                rows.append(max(found, key=lambda x: (-token_distance(x["value"].split(), goal), x["trust"], x["row"]))["row"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, b.schema.field(2).type.value_type.field("row").type)], names=["g", "field", "row"])

    def block_profiles(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([pickle.dumps(profile_of(found)) for found in b.column(3).to_pylist()], pa.binary())], names=["g", "field", "block", "profile"])

    def merged(batches):
        for b in batches:
            out = []
            for found in b.column(3).to_pylist():
                first, *rest = (pickle.loads(x["profile"]) for x in sorted(found, key=lambda x: x["block"]))
                for other in rest:
                    first.merge(other)
                out.append(pickle.dumps(first))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], names=["g", "field", "block", "profile"])

    schema = f"g {gtype}, field string, block int, profile binary"
    member = F.collect_list(F.struct("value", "votes", "trust", "row")).alias("found")
    # groups of one value need no alignment: the value is the consensus
    alone = d.where("n = 1").select("g", "field", "row")
    # alignment is heavy for its bytes, so the number of tasks is set here and not left to the size of the data
    conf = d.sparkSession.conf.get("spark.sql.shuffle.partitions")
    tasks = max(2 * d.sparkSession.sparkContext.defaultParallelism, int(conf))
    one_block = d.where(f"n between 2 and {BLOCK}").repartition(tasks, "g", "field").groupBy("g", "field").agg(member)
    alone = alone.unionByName(one_block.mapInArrow(survivor, f"g {gtype}, field string, row {rtype}"))
    most = d.agg(F.max("n")).first()[0] or 0
    if most <= BLOCK:
        return alone.select("g", "field", F.col("row").cast(rtype).alias("row"))
    several = d.where(f"n > {BLOCK}").repartition(tasks, "g", "field", "block")
    profiles = several.groupBy("g", "field", "block").agg(member).mapInArrow(block_profiles, schema)
    blocks = -(-most // BLOCK)
    while blocks > 1:
        up = profiles.withColumn("parent", F.floor(F.col("block") / 16).cast("int")).groupBy("g", "field", "parent")
        profiles = cut(up.agg(F.collect_list(F.struct("block", "profile")).alias("found")).mapInArrow(merged, schema))
        blocks = -(-blocks // 16)

    @F.pandas_udf("string")
    def consensus(profile: pd.Series) -> pd.Series:
        return profile.map(lambda p: " ".join(pickle.loads(p).consensus()))

    @F.pandas_udf("int")
    def distance(value: pd.Series, goal: pd.Series) -> pd.Series:
        return pd.Series([token_distance(v.split(), c.split()) for v, c in zip(value, goal, strict=True)], dtype="int32")

    goals = profiles.select("g", "field", consensus("profile").alias("goal"))
    scored = several.join(goals, ["g", "field"]).withColumn("distance", distance("value", "goal"))
    best = scored.groupBy("g", "field").agg(F.max_by("row", F.struct(-F.col("distance"), "trust", "row")).alias("row"))
    return alone.unionByName(best).select("g", "field", F.col("row").cast(rtype).alias("row"))
