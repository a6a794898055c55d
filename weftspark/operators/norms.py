"""2-norms in one aggregation that neither overflows nor underflows.

Squares are summed at three scales, for large, ordinary and small magnitudes, so partial sums merge and no second pass
over the values is needed to find the largest first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magnitudes beyond these powers of two are scaled by 2**-SHIFT, or 2**SHIFT, before they are squared.
LIMIT, SHIFT = 300, 600
_UP, _DOWN = 2.0**SHIFT, 2.0**-SHIFT


def squares(v: Column | list[Column], name: str) -> list[Column]:
    """Aggregates ``{name}_big``, ``{name}_mid`` and ``{name}_low`` of the finite ones of one column, or of several."""
    parts = v if isinstance(v, list) else [v]

    def total(when, scale: float) -> Column:
        out = F.lit(0.0)
        for p in parts:
            p = p.cast("double")
            out = out + F.when(when(F.abs(p)), (p * F.lit(scale)) * (p * F.lit(scale))).otherwise(0.0)
        return F.coalesce(F.sum(out), F.lit(0.0))

    top, low = F.lit(2.0**LIMIT), F.lit(2.0**-LIMIT)
    big = total(lambda a: (a > top) & (a < float("inf")), _DOWN)
    mid = total(lambda a: (a <= top) & (a >= low), 1.0)
    small = total(lambda a: a < low, _UP)
    return [big.alias(f"{name}_big"), mid.alias(f"{name}_mid"), small.alias(f"{name}_low")]


def norm_of(name: str) -> Column:
    """The 2-norm from the three sums."""
    big, mid, low = (F.col(f"{name}_{k}") for k in ("big", "mid", "low"))
    down = lambda x: x * F.lit(_DOWN) * F.lit(_DOWN)
    return F.when(big > 0, F.sqrt(big + down(mid)) * F.lit(_UP)).when(mid > 0, F.sqrt(mid + down(low))).otherwise(F.sqrt(low) * F.lit(_DOWN))
