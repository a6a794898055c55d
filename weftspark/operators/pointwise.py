"""Pointwise operations over arrays that line up.

All inputs have the same spatial layout and batch rank; a batch extent of 1 expands to the output's.  An input that
expands lacks that coordinate in the join key, so it is never copied out.  ``f`` maps Columns to a Column (a pair of
them for complex results), which keeps the operation inside generated code; a ``pandas_udf`` works as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MultiInputError, PointwiseError
from .array import DTYPES, NDArray


def batch_shape(arrays: Sequence[NDArray], error=PointwiseError) -> tuple[int, ...]:
    """The common batch shape: each extent is the same everywhere, or 1."""
    first = arrays[0]
    if any(a.layout != first.layout for a in arrays):
        raise error("the inputs differ in layout")
    if any(len(a.extra) != len(first.extra) for a in arrays):
        raise error("the inputs differ in batch rank")
    out = []
    for ns in zip(*(a.extra for a in arrays), strict=True):
        wide = {n for n in ns if n != 1}
        if len(wide) > 1:
            raise error(f"batch extents {ns} don't fit together")
        out.append(wide.pop() if wide else 1)
    return tuple(out)


def _fit(arrays: Sequence[NDArray], extra: tuple[int, ...], error=PointwiseError) -> None:
    for a in arrays:
        if len(a.extra) != len(extra) or any(n not in (1, m) for n, m in zip(a.extra, extra, strict=True)):
            raise error(f"batch extents {a.extra} don't expand to {extra}")


def aligned(arrays: Sequence[NDArray], extra: tuple[int, ...]) -> DataFrame:
    """Coordinates of the output, and per input m its value as ``a{m}`` (a struct for complex ones)."""
    first = arrays[0]
    out, have = None, set()
    names = [*first.batch, *first.space]
    order = sorted(range(len(arrays)), key=lambda m: -sum(n == e and e != 1 for n, e in zip(arrays[m].extra, extra, strict=True)))
    for m in order:
        a = arrays[m]
        keep = [c for c, n, e in zip(a.batch, a.extra, extra, strict=True) if n == e]
        df = a.df.select(*keep, *a.space, a.value.alias(f"a{m}"))
        if out is None:
            out, have = df, {*keep}
        else:
            # the two may know different batch coordinates; those that both know, and all of space, are the key
            out = out.join(df, [*(c for c in keep if c in have), *a.space])
            have |= {*keep}
    missing = [c for c in first.batch if c not in have]
    if missing:  # only extents that no input has in full: each input has 1 there, and the output more (or none)
        sizes = dict(zip(first.batch, extra, strict=True))
        for c in missing:
            out = out.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sizes[c] - 1).cast("long")))) if sizes[c] else out.withColumn(c, F.lit(0).cast("long")).filter(F.lit(False))
    return out.select(*names, *[f"a{m}" for m in range(len(arrays))])


def _result(df: DataFrame, like: NDArray, extra: tuple[int, ...], v, dtype: str) -> NDArray:
    kind = DTYPES[dtype]
    if dtype.startswith("c"):
        values = [x.cast(kind).alias(c) for x, c in zip(v, ("re", "im"), strict=True)]
    else:
        values = [v.cast(kind).alias("v")]
    return like.with_df(df.select(*like.coords, *values), extra=extra, dtype=dtype)


def pointwise(arrays: Sequence[NDArray], f: Callable[..., Column], dtype: str | None = None, extra: Sequence[int] | None = None) -> NDArray:
    """f(a, b, ..) of two, three or more arrays; ``extra`` is the output's batch shape."""
    if not arrays:
        raise PointwiseError("an input is needed")
    common = batch_shape(arrays)
    extra = common if extra is None else tuple(extra)
    _fit(arrays, extra)
    df = aligned(arrays, extra)
    return _result(df, arrays[0], extra, f(*[F.col(f"a{m}") for m in range(len(arrays))]), dtype or arrays[0].dtype)


def pointwise2(a: NDArray, b: NDArray, f, dtype: str | None = None, extra=None) -> NDArray:
    return pointwise([a, b], f, dtype, extra)


def pointwise3(a: NDArray, b: NDArray, c: NDArray, f, dtype: str | None = None, extra=None) -> NDArray:
    return pointwise([a, b, c], f, dtype, extra)


def pointwise_in_place(a: NDArray, others: Sequence[NDArray], f) -> NDArray:
    """The result has the shape and type of ``a``; only the others may expand."""
    return pointwise([a, *others], f, a.dtype, a.extra)


def _same(arrays: Sequence[NDArray]) -> None:
    if not arrays:
        raise MultiInputError("an input is needed")
    if any(a.dtype != arrays[0].dtype for a in arrays):
        raise MultiInputError("the inputs differ in type")


def many(arrays: Sequence[NDArray], extra: tuple[int, ...] | None = None) -> DataFrame:
    """Output coordinates and ``values``: the inputs' values as one array."""
    _same(arrays)
    common = batch_shape(arrays, MultiInputError)
    extra = common if extra is None else extra
    _fit(arrays, extra, MultiInputError)
    first = arrays[0]
    return aligned(arrays, extra).select(*first.coords, F.array(*[f"a{m}" for m in range(len(arrays))]).alias("values"))


def pointwise_many(arrays: Sequence[NDArray], f: Callable[[Column], Column], dtype: str | None = None, extra=None) -> NDArray:
    """f of an array column that holds the inputs' values in order."""
    _same(arrays)
    extra = batch_shape(arrays, MultiInputError) if extra is None else tuple(extra)
    return _result(many(arrays, extra), arrays[0], extra, f(F.col("values")), dtype or arrays[0].dtype)


def pointwise_many_in_place(a: NDArray, others: Sequence[NDArray], f) -> NDArray:
    return pointwise_many([a, *others], f, a.dtype, a.extra)
