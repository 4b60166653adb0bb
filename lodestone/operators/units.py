"""Quantities recorded in different units, converted to the base unit of their quantity.

Stated units are resolved by broadcast joins with the rule-built alias table. Missing units are predicted: every
candidate unit of the quantity is scored by a calibrated random forest from the magnitude it would imply, how usual it is
and what the neighbouring fields say; confident assignments are converted, the others are routed for review.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.unit_table import unit_key, unit_rows
from lodestone.session import cut, small

#: Spellings of a unit that say the unit is missing, lower-cased.
MISSING_UNITS = ("", "-", "--", "?", "n/a", "na", "none", "null", "nan", "unknown", "not given", "not stated", "unspecified", "tbd")


@dataclass(frozen=True)
class UnitModelParams:
    """Parameters of the missing-unit classifier; ``max_train_rows`` bounds the labelled rows it is fitted on.

    A prediction is converted from a calibrated probability of ``confident`` on if the text names the same unit, and of
    ``silent`` on if it names none.
    """

    max_train_rows: int = 6000
    trees: int = 24
    depth: int = 7
    confident: float = 0.5
    silent: float = 0.95
    seed: int = 7


@dataclass(frozen=True)
class UnitModel:
    """Usage statistics, forest and calibration; rows whose ``row_hash`` is at most ``last`` are those it was fitted on."""

    stats: DataFrame
    forest: object
    isotonic: object | None
    last: int


def quantity_key(name: Column) -> Column:
    """Comparable spelling of a quantity name: letters and digits only, lower-cased."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]+", ""))


def is_missing_unit(unit: Column) -> Column:
    return unit.isNull() | F.lower(F.trim(unit)).isin(*MISSING_UNITS)


def _aliases(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    rows = {}
    for q, k, low, f, o in unit_rows():
        if low:
            rows[q, "~" + low] = (f, o)
        rows[q, k] = (f, o)
    return spark.createDataFrame([(q, k, f, o) for (q, k), (f, o) in rows.items()], "quantity string, ukey string, factor double, offset double")


def resolve_quantities(df: DataFrame, units: DataFrame, quantity_col: str) -> DataFrame:
    """Add ``quantity`` and ``base_unit``: the entry of ``units`` that the freely written quantity means (else null)."""
    names = units.select("physical_quantity", "base_unit", F.explode(F.concat(F.array("physical_quantity"), F.split(F.coalesce("other_names", F.lit("")), r"\s*;\s*"))).alias("n"))
    dim = names.select(F.col("physical_quantity").alias("quantity"), "base_unit", quantity_key(F.col("n")).alias("qkey")).where("qkey <> ''").dropDuplicates(["qkey"])
    return df.withColumn("qkey", quantity_key(F.col(quantity_col))).join(small(dim), "qkey", "left").drop("qkey")


def attach_factor(df: DataFrame, key: str) -> DataFrame:
    """Add ``factor`` and ``offset`` of the unit key in column ``key`` for the row's quantity: exact case first."""
    dim = _aliases(df)
    a = dim.select("quantity", F.col("ukey").alias(key), F.col("factor").alias("f1"), F.col("offset").alias("o1"))
    b = dim.select("quantity", F.col("ukey").alias("ulow"), F.col("factor").alias("f2"), F.col("offset").alias("o2"))
    w = df.withColumn("ulow", F.concat(F.lit("~"), F.lower(key)))
    w = w.join(F.broadcast(a), ["quantity", key], "left").join(F.broadcast(b), ["quantity", "ulow"], "left")
    return w.withColumn("factor", F.coalesce("f1", "f2")).withColumn("offset", F.coalesce("o1", "o2")).drop("ulow", "f1", "f2", "o1", "o2")


_NUMBER = r"(?<![\w.,])([-+]?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?(?:\s?[x×·*]\s?10\^?[-−⁻]?[\d⁰¹²³⁴⁵⁶⁷⁸⁹]+)?)(?=(.{0,40}))"


def unit_after_value(context: Column, value: Column, quantity: Column) -> Column:
    """Key of the unit of ``quantity`` written directly after ``value`` in ``context``; null if there is none."""
    by_quantity: dict[str, dict[str, bool]] = {}
    for q, k, low, _, _ in unit_rows():
        by_quantity.setdefault(q, {})[k] = low is not None and len(low) > 1
    pairs = F.arrays_zip(F.regexp_extract_all(context, F.lit(_NUMBER), 1).alias("n"), F.regexp_extract_all(context, F.lit(_NUMBER), 2).alias("t"))

    def number(x: Column) -> Column:
        s = F.translate(x, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻−,^ ", "0123456789--")
        mantissa = F.regexp_extract(s, r"^([-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)", 1).try_cast("double")
        power = F.coalesce(F.regexp_extract(s, r"[x×·*]10([-+]?\d+)$", 1).try_cast("int"), F.lit(0))
        return mantissa * F.pow(F.lit(10.0), power)

    def unit(tail: Column) -> Column:
        key = unit_key(tail)
        out = F.lit("")
        for q, keys in by_quantity.items():
            alternatives = "|".join(("(?i:\\Q" if keys[k] else "(?:\\Q") + k + "\\E)" for k in sorted(keys, key=lambda k: (-len(k), k)))
            out = F.when(quantity == q, F.regexp_extract(key, rf"^(?:{alternatives})(?![\p{{L}}\p{{N}}/%])", 0)).otherwise(out)
        return out

    hits = F.filter(pairs, lambda x: F.abs(number(x["n"]) - value) <= F.abs(value) * 1e-9)
    named = F.filter(F.transform(hits, lambda x: unit(x["t"])), lambda k: k != "")
    return F.get(named, F.lit(0))


def prepare(df: DataFrame, units: DataFrame) -> DataFrame:
    """Resolve quantity, stated unit and the unit named in the context of every row with a usable value.

    Needs columns table_name, row_id, value, unit, physical_quantity, context, source; other columns are dropped.
    Rows with a null, zero or NaN value or without a known quantity are no cases and are left out.
    """
    w = df.select("table_name", "row_id", "value", "unit", "physical_quantity", "context", "source").where("value is not null and value <> 0 and not isnan(value)")
    w = resolve_quantities(w, units, "physical_quantity").where("quantity is not null")
    missing = is_missing_unit(F.col("unit"))
    w = w.withColumn("missing", missing).withColumn("skey", F.when(~missing, unit_key(F.col("unit"))))
    w = attach_factor(w, "skey").withColumnsRenamed({"factor": "stated_factor", "offset": "stated_offset"})
    return w


def with_context_unit(w: DataFrame) -> DataFrame:
    w = w.withColumn("ckey", unit_after_value(F.col("context"), F.col("value"), F.col("quantity")))
    return attach_factor(w, "ckey").withColumnsRenamed({"factor": "context_factor", "offset": "context_offset"})


def row_hash() -> Column:
    """Order of the rows by which the labelled sample is taken, whatever their partitions."""
    return F.xxhash64("table_name", "row_id")


_FEATURES = ["magnitude", "raw", "usual", "mention", "category", "origin"]


def _features(rows: DataFrame, stats: DataFrame, keep_mention: Column) -> DataFrame:
    """One row per row and candidate unit with the classifier's features."""
    w = rows.join(F.broadcast(stats), "quantity")
    base = F.abs(F.col("value") * F.col("factor") + F.col("offset"))
    mention = F.when(F.col("context_factor").isNull() | ~keep_mention, 0.0).when((F.col("context_factor") == F.col("factor")) & (F.col("context_offset") == F.col("offset")), 1.0).otherwise(-1.0)
    return w.select(
        *rows.columns, "factor", "offset",
        ((F.log10(F.greatest(base, F.lit(1e-30))) - F.col("mid")) / F.greatest(F.col("spread"), F.lit(0.1))).alias("magnitude"),
        F.log10(F.abs("value")).alias("raw"), "usual", mention.alias("mention"), F.col("category").cast("double").alias("category"),
        (F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(16))).cast("double").alias("origin"),
    )


def fit_unit_model(prepared: DataFrame, params: UnitModelParams = UnitModelParams()):
    """``UnitModel`` of forest and calibration fitted on a bounded sample of rows with stated units.

    The sample is the rows of least ``row_hash``, so the same rows give the same model. The usage statistics (how often each unit is stated, the spread of magnitudes) cover all rows. Their size is bounded
    by the alias table. Returns None if no row states a known unit.
    """
    stated = prepared.where("stated_factor is not null")
    log_base = F.log10(F.greatest(F.abs(F.col("value") * F.col("stated_factor") + F.col("stated_offset")), F.lit(1e-30)))
    usage = stated.groupBy("quantity", "stated_factor", "stated_offset").agg(F.count(F.lit(1)).alias("n"), F.sum(log_base).alias("s"), F.sum(log_base * log_base).alias("ss"))
    got = usage.toPandas()  # at most one row per alias-table entry
    if got.empty:
        return None
    total = got.groupby("quantity")[["n", "s", "ss"]].transform("sum")
    mid = total["s"] / total["n"]
    stats = pd.DataFrame({"quantity": got["quantity"], "factor": got["stated_factor"], "offset": got["stated_offset"], "usual": got["n"] / total["n"], "mid": mid, "spread": ((total["ss"] / total["n"] - mid**2).clip(lower=0) ** 0.5)})
    order = {q: i for i, q in enumerate(sorted(stats["quantity"].unique()))}
    stats["category"] = stats["quantity"].map(order)
    spark = prepared.sparkSession
    stats_df = spark.createDataFrame(stats, "quantity string, factor double, offset double, usual double, mid double, spread double, category int")
    # rows beyond a multiple of the share that is needed are left out before the sort
    share = min(1.0, 1.5 * params.max_train_rows / max(1, int(got["n"].sum())) + 0.001)
    near = stated.withColumn("h", row_hash()).where(F.col("h") <= int(-(2**63) + share * (2**64 - 1)) - (1 if share >= 1 else 0))
    sample = cut(with_context_unit(near.orderBy("h", "table_name", "row_id", "value").limit(params.max_train_rows)))
    last = sample.agg(F.max("h")).first()[0]
    if last is None:
        return None
    hashed = F.pmod(F.xxhash64("table_name", "row_id"), F.lit(10))
    labelled = _features(sample.withColumn("bucket", hashed), stats_df, F.pmod(F.col("bucket"), F.lit(2)) == 0)
    label = ((F.col("factor") == F.col("stated_factor")) & (F.col("offset") == F.col("stated_offset"))).cast("double")
    labelled = cut(VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(labelled.withColumn("label", label)).select("bucket", "label", "features"))
    train, held = labelled.where("bucket < 8"), labelled.where("bucket >= 8")
    if train.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=params.trees, maxDepth=params.depth, seed=params.seed, subsamplingRate=0.7).fit(train)
    scored = forest.transform(held).select("label", vector_to_array("probability")[1].alias("p"))
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label").fit(scored) if not held.isEmpty() else None
    return UnitModel(stats_df, forest, isotonic, last)


def infer_units(missing: DataFrame, model: UnitModel, params: UnitModelParams = UnitModelParams()) -> DataFrame:
    """Best candidate unit per row without unit: factor, offset, calibrated probability ``p`` and ``decision``.

    ``decision`` is 'convert' where p reaches ``params.confident`` and the text names this unit after the value, or
    ``params.silent`` and the text names no unit there, else 'review'. The only shuffle groups the few
    candidates of each row by the row's key, so no key gathers more than the candidates of one quantity.
    """
    forest, isotonic = model.forest, model.isotonic
    cand = VectorAssembler(inputCols=_FEATURES, outputCol="features").transform(_features(missing, model.stats, F.lit(True)))
    cand = forest.transform(cand).withColumn("p", vector_to_array("probability")[1])
    if isotonic is not None:
        cand = isotonic.setPredictionCol("calibrated").transform(cand.drop("prediction")).withColumn("rank", F.col("p")).withColumn("p", F.col("calibrated"))
    else:
        cand = cand.withColumn("rank", F.col("p"))
    named = (F.col("factor") == F.col("context_factor")) & (F.col("offset") == F.col("context_offset"))
    needed = F.when(named, params.confident).when(F.col("context_factor").isNull(), params.silent).otherwise(2.0)
    best = cand.groupBy("table_name", "row_id", "quantity", "value").agg(F.max(F.struct("p", "rank", "usual", "factor", "offset")).alias("b"), F.first("context_factor").alias("context_factor"), F.first("context_offset").alias("context_offset"))
    return best.select("table_name", "row_id", "quantity", "value", "b.factor", "b.offset", "b.p", "context_factor", "context_offset").withColumn("decision", F.when(F.col("p") >= needed, "convert").otherwise("review"))


@F.pandas_udf(T.StringType())
def scientific(values: pd.Series) -> pd.Series:
    """``%.3e`` with C's correctly rounded digits (the JVM's formatter rounds the shortest decimal instead)."""
    return values.map(lambda v: "%.3e" % v, na_action="ignore")


def converted(df: DataFrame, factor: str, offset: str) -> DataFrame:
    base = F.col("value") * F.col(factor) + F.col(offset)
    return df.select("table_name", "row_id", "quantity", scientific(base).alias("value_base"))
