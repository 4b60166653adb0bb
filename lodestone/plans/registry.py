"""Registration of queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Catalogue:
    """Queries of one module; ``add(name, sql)`` decorates a function of (spark, sf_dir)."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql
            return f

        return keep


#: Moves values that lie just between two roundings, as means of a few short decimals do, to one side in any engine.
_NUDGE = 1.000000000001


def sig(c: Column | str, digits: int = 8) -> Column:
    """Value rounded to significant digits: sums differ in the last ones with the order of summation.

    Only positive powers of ten are used, which are exact in any engine.
    """
    c = F.col(c) if isinstance(c, str) else c
    e = F.floor(F.log10(F.abs(c)))
    up, down = F.pow(F.lit(10.0), e), F.pow(F.lit(10.0), -e)
    return F.when(c == 0, F.lit(0.0)).when(e >= 0, F.round(c / up * _NUDGE, digits - 1) * up).otherwise(F.round(c * down * _NUDGE, digits - 1) / down)


def sig_sql(x: str, digits: int = 8) -> str:
    """``sig`` in SQL."""
    e = f"floor(log10(abs({x})))"
    n = f"{_NUDGE:.12f}::double"
    return f"case when ({x}) = 0 then 0.0 when {e} >= 0 then round(({x}) / pow(10.0, {e}) * {n}, {digits - 1}) * pow(10.0, {e}) else round(({x}) * pow(10.0, -{e}) * {n}, {digits - 1}) / pow(10.0, -{e}) end"
