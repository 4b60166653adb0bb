"""Ranking, top-k, binning and aliasing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key in ``order``.

    ``row_number() <= k`` lets Spark keep only k rows per key on the map side (WindowGroupLimit) before it shuffles, so a
    hot key is never gathered whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def _blocks(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows range-partitioned by key and order and cut, with their partition as ``__pid``: a hot key spans many blocks."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(n, *keys, *order).withColumn("__pid", F.spark_partition_id()))


def _offsets(blocks: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Per key and block what the blocks before it hold; one row per key and block, so the window over a key is short."""
    w = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(*keys, "__pid").agg(amount.alias("__sum"))
    return sums.withColumn("__before", F.coalesce(F.sum("__sum").over(w), F.lit(0))).drop("__sum")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Join on null-safe keys and block, keeping one copy of the keys."""
    b = b.withColumnsRenamed({c: f"__r_{c}" for c in [*keys, "__pid"]})
    on = F.col("__pid") == F.col("__r___pid")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return a.join(b, on).drop(*[f"__r_{c}" for c in [*keys, "__pid"]])


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Row number of every row within its key; ``order`` must be total.

    Rows are ranked within range blocks and each block adds the size of the blocks before it, so that no task sorts a
    whole hot key.
    """
    b = _blocks(df, keys, order)
    local = b.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__pid").orderBy(*order)))
    return _same(local, _offsets(b, keys, F.count(F.lit(1))), keys).withColumn(out, (F.col("__rn") + F.col("__before")).cast("long")).drop("__rn", "__before", "__pid")


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Running sum within each key in a total order, by blocks as in ``ranked``."""
    b = _blocks(df, keys, order)
    w = Window.partitionBy(*keys, "__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumn("__rs", F.sum(value).over(w))
    return _same(local, _offsets(b, keys, F.sum(value)), keys).withColumn(out, F.col("__rs") + F.col("__before")).drop("__rs", "__before", "__pid")


def shifted(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, by: int = 1) -> DataFrame:
    """Value of the row ``by`` places later within its key (negative: earlier), null beyond the ends.

    Looked up by rank with an equi-join on key and rank, which spreads a hot key.
    """
    r = cut(ranked(df, keys, order, "__rank"))
    other = r.select(*[F.col(c).alias(f"__o_{c}") for c in keys], (F.col("__rank") - by).alias("__at"), F.col(value).alias(out))
    on = F.col("__rank") == F.col("__at")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    return r.join(other, on, "left").drop("__rank", "__at", *[f"__o_{c}" for c in keys])


def letter_alias(df: DataFrame, column: str, out: str) -> DataFrame:
    """Aliases [A] to [Z], then [27] and on, in sorted order of a column's distinct values, ranked by range blocks."""
    r = ranked(df.select(column).distinct(), [], [F.col(column)], "__i")
    i = F.col("__i")
    return r.select(column, F.concat(F.lit("["), F.when(i <= 26, F.char(i.cast("int") + 64)).otherwise(i.cast("string")), F.lit("]")).alias(out))


def equal_width_bins(df: DataFrame, column: str, bins: int, out: str) -> DataFrame:
    """Zero-based bin of equal width over the column's range, which one aggregation finds and broadcasts as one row."""
    r = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    at = F.least(F.floor((F.col(column) - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / bins)), F.lit(bins - 1))
    return df.join(F.broadcast(r)).withColumn(out, F.coalesce(at, F.lit(0)).cast("int")).drop("__lo", "__hi")
