"""Plain unit factors for values whose unit is written in one of the usual spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Factors to base units; a table of any other factors can be passed instead.
FACTORS = {"kW": 1000.0, "mm/min": 1 / 60, "GPa": 1000.0, "kg/m3": 0.001, "MHz": 1000.0}


def normalise_units(df: DataFrame, unit: str, value: str, out: str, factors: dict[str, float] | None = None) -> DataFrame:
    """Add ``out``: the value times the factor of its unit; unknown units keep the value."""
    factors = factors or FACTORS
    dim = df.sparkSession.createDataFrame(list(factors.items()), "__u string, __f double")
    joined = df.join(F.broadcast(dim), F.col(unit) == F.col("__u"), "left")
    return joined.withColumn(out, F.col(value) * F.coalesce("__f", F.lit(1.0))).drop("__u", "__f")
