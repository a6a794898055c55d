"""Running global reductions over a stream of cells.

Sums, extremes and counts of an array that arrives in pieces, with one row of state for each batch coordinate, under
the rules of ``operators.reduce``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reduce import float_sum


def running(cells: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """sum, min, max, squares and count of ``value`` by ``keys``: for ``outputMode("complete")`` or ``"update"``."""
    v = F.col(value).cast("double")
    nan = F.coalesce(F.bool_or(F.isnan(v)), F.lit(False))
    extreme = lambda f: F.when(nan, F.lit(float("nan"))).otherwise(f(v))
    return cells.groupBy(*keys).agg(float_sum(v).alias("sum"), extreme(F.min).alias("min"), extreme(F.max).alias("max"), F.sum(v * v).alias("squares"), F.count(F.lit(1)).alias("cells"))
