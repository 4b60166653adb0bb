"""Aggregates over numeric facts: summaries, consensus, contradiction, fusion and agreement.

Every operator takes the fact columns' names, so that it works on any table of (document, material, quantity, value).
Null values never count. Aggregations are plain ``groupBy`` with partial aggregation; pairs are formed only after facts
are reduced to one row per document and entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import ranked, running_sum
from lodestone.session import cut


def sample_std(c: str) -> Column:
    """Sample standard deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def quantity_summary(df: DataFrame, quantity: str, doc: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(quantity).agg(F.count(value).alias("n"), F.count_distinct(doc).alias("docs"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per key with the linearly interpolated quantiles that ``shares`` names; null values do not count.

    Values are ranked by range blocks, so that a hot key is neither sorted nor gathered in one task; exact.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    r = ranked(rows, keys, [F.col("__v")], "__r")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    j = r.join(n.withColumnsRenamed({k: f"__k_{k}" for k in keys}), on).drop(*[f"__k_{k}" for k in keys])
    at = {name: 1 + share * (F.col("__n") - 1) for name, share in shares.items()}
    wanted = F.lit(False)
    for p in at.values():
        wanted = wanted | F.col("__r").isin(F.floor(p), F.ceil(p))
    ends = [F.max(F.when(F.col("__r") == f(p), F.col("__v"))).alias(f"__{e}{i}") for i, p in enumerate(at.values()) for e, f in (("lo", F.floor), ("hi", F.ceil))]
    g = j.where(wanted).groupBy(*keys, "__n").agg(*ends)
    return g.select(*keys, *[(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (p - F.floor(p))).alias(name) for i, (name, p) in enumerate(at.items())])


def most_frequent(df: DataFrame, keys: list[str], value: str, out: str = "mode") -> DataFrame:
    """The most frequent value of each key, of equally frequent ones the smaller; null values do not count."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    g = c.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("k"), F.col(value).alias("v"))).alias("b"))
    return g.select(*keys, F.col("b.v").alias(out))


def consensus(df: DataFrame, entity: str, doc: str, value: str, unit: str | None = None, least_docs: int = 2) -> DataFrame:
    """Entities reported by at least ``least_docs`` documents and two values: counts, mean, spread, range, median and the
    smallest ``unit``."""
    rows = df.where(F.col(entity).isNotNull() & F.col(value).isNotNull())
    first = [F.min(unit).alias("unit")] if unit else []
    out = rows.groupBy(entity).agg(F.count_distinct(doc).alias("docs"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"), *first)
    return out.where((F.col("docs") >= least_docs) & (F.col("n") >= 2)).join(quantiles(rows, [entity], value, {"median": 0.5}), entity)


def document_means(df: DataFrame, entity: str, doc: str, value: str) -> DataFrame:
    return df.where(F.col(entity).isNotNull() & F.col(value).isNotNull()).groupBy(entity, doc).agg(F.avg(value).alias("mean"))


def contradiction_pairs(df: DataFrame, entity: str, doc: str, value: str, ratio: float = 2.0) -> DataFrame:
    """Documents whose means of one entity differ by more than ``ratio``: one row per document and entity with its mean and
    spread, how many documents contradict it, the largest ratio and its severity. Means of zero or less take no part.

    The pairs themselves are quadratic in the documents of an entity and are counted instead: the means are brought into
    one order with the bounds beyond which a document is contradicted, by range blocks, so that no entity is one task's.
    """
    m = df.where(F.col(entity).isNotNull() & F.col(value).isNotNull()).groupBy(entity, doc).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).where("mean > 0")
    m = cut(m)
    stats = m.groupBy(entity).agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"), F.count(F.lit(1)).alias("docs"))
    # at equal values a lower bound comes before the means and an upper one after them
    marks = m.select(entity, doc, F.explode(F.array(F.struct(F.col("mean").alias("at"), F.lit(1).alias("kind")), F.struct((F.col("mean") / ratio).alias("at"), F.lit(0).alias("kind")), F.struct((F.col("mean") * ratio).alias("at"), F.lit(2).alias("kind")))).alias("x")).select(entity, doc, "x.at", "x.kind")
    order = [F.col("at"), F.col("kind"), F.col(doc)]
    seen = running_sum(marks.withColumn("one", (F.col("kind") == 1).cast("int")), [entity], order, "one", "upto")
    bounds = seen.where("kind <> 1").groupBy(entity, doc).agg(F.max(F.when(F.col("kind") == 0, F.col("upto"))).alias("below"), F.max(F.when(F.col("kind") == 2, F.col("upto"))).alias("within"))
    on = F.col(doc).eqNullSafe(F.col("__doc"))
    j = m.join(stats, entity).join(bounds.withColumnsRenamed({doc: "__doc", entity: "__entity"}), (F.col(entity) == F.col("__entity")) & on)
    worst = F.greatest(F.col("hi") / F.col("mean"), F.col("mean") / F.col("lo"))
    j = j.withColumn("contradicting", F.col("below") + F.col("docs") - F.col("within")).withColumn("ratio", worst).where("contradicting > 0")
    return j.withColumn("severity", F.when(F.col("ratio") > 10, "critical").when(F.col("ratio") > 5, "high").otherwise("moderate")).select(entity, doc, "mean", "std", "contradicting", "ratio", "severity")


def variance_contradictions(df: DataFrame, keys: list[str], value: str, share: float = 0.5) -> DataFrame:
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return g.where((F.col("n") >= 2) & (F.col("std") > share * F.col("mean")))


def grouped(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """count, mean, sample std (0 for one value), min, max and, with ``weight``, its mean."""
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), sample_std(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi")]
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(*aggs, *([F.avg(weight).alias("weight")] if weight else []))


def fused_numeric(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, spread and confidence class by coefficient of variation (1 where the mean is 0)."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    cv = F.when(F.col("mean") == 0, 1.0).otherwise(F.col("std") / F.abs("mean"))
    level = F.when((F.col("cv") < 0.1) & (F.col("n") >= 2), "HIGH").when((F.col("cv") < 0.3) | (F.col("n") == 1), "MODERATE").otherwise("LOW")
    return g.withColumn("cv", cv).withColumn("level", level)


def fused_categorical(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value (ties: the smaller) and its share."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("b"), F.sum("n").alias("total"))
    return g.select(*keys, F.col("b.v").alias("mode"), (-F.col("b.k") / F.col("total")).alias("share"))


def deduplicated(df: DataFrame, keys: list[str], weight: str, order: str) -> DataFrame:
    """One row per key: the largest weight, of equal ones the first in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct((-F.coalesce(F.col(weight), F.lit(float("-inf")))).alias("w"), F.col(order).alias("o"), *[F.col(c).alias(f"c_{c}") for c in rest])).alias("b"))
    return best.select(*keys, *[F.col(f"b.c_{c}").alias(c) for c in rest])


def cooccurrence(df: DataFrame, item: str, doc: str) -> DataFrame:
    """Items a < b and the number of documents that hold both.

    Items are made distinct per document first. The pairs of a document are formed inside its row, so documents must hold
    a bounded set of items, such as the entries of a vocabulary.
    """
    sets = df.where(F.col(item).isNotNull()).select(doc, item).distinct().groupBy(doc).agg(F.array_sort(F.collect_set(item)).alias("s"))
    pair = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("docs"))


def exclusive_intersections(df: DataFrame, term: str, model: str) -> DataFrame:
    """How many terms belong to exactly each combination of models."""
    combos = df.select(term, model).distinct().groupBy(term).agg(F.array_join(F.array_sort(F.collect_set(model)), "&").alias("combo"))
    return combos.groupBy("combo").agg(F.count(F.lit(1)).alias("terms"))
