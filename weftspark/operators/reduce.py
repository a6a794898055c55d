"""Global reductions.  Each gives a DataFrame of one row with column ``value``, so that it composes lazily.

* sums of floats: NaN if an input is NaN or both infinities occur, else the infinity that occurs, else the IEEE sum;
* sums of integers are checked, also of mapped, zipped and many arrays: ``ordered`` fails if any partial sum in storage
  order, block by block and then over blocks, leaves the type; ``total`` is one plain aggregation that checks only the
  total, for speed at scale;
* min and max are NaN if an input is, and null for no inputs;
* the 2-norm is one aggregation of squares at three scales: NaN beats infinity beats numbers, no inputs give 0;
* any and all take every value but zero as true, NaN too.

What a query finds wrong with the data is raised when it runs; inside ``errors.typed()`` as one of this library's errors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ReductionError
from .array import DTYPES, NDArray
from .norms import norm_of, squares
from .pointwise import aligned, batch_shape
from .tiles import Tiles

_INTS = {"i8": (-(2**7), 2**7 - 1), "u8": (0, 2**8 - 1), "i16": (-(2**15), 2**15 - 1), "u16": (0, 2**16 - 1), "i32": (-(2**31), 2**31 - 1), "u32": (0, 2**32 - 1), "i64": (-(2**63), 2**63 - 1), "u64": (0, 2**64 - 1)}
_INF = float("inf")
OVERFLOW = "ReductionError: integer overflow in a global sum"


def _is_float(dtype: str) -> bool:
    return dtype[0] in "fc"


def float_sum(v: Column) -> Column:
    """The sum of a float column under the rules above; 0 for no inputs."""
    up, down = F.coalesce(F.bool_or(v == _INF), F.lit(False)), F.coalesce(F.bool_or(v == -_INF), F.lit(False))
    nan = F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)) | (up & down)
    return F.when(nan, F.lit(float("nan"))).when(up, F.lit(_INF)).when(down, F.lit(-_INF)).otherwise(F.coalesce(F.sum(v), F.lit(0.0)))


def int_sum(v: Column, dtype: str) -> Column:
    low, high = _INTS[dtype]
    total = F.coalesce(F.sum(v.cast("decimal(20,0)")), F.lit(0))
    inside = total.between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)"))
    return F.when(inside, total).otherwise(F.raise_error(F.lit(OVERFLOW)).cast("decimal(38,0)")).cast(DTYPES[dtype])


#: Cells, or results, that are listed and folded together.
FAN = 1 << 12


def _in_order(parts: DataFrame, keys: list[str], order: str, value: Column, fold: Callable[[Column], Column], most: int) -> DataFrame:
    """Fold ``value`` over ``order``, which counts from 0 up to ``most`` at most, for each of ``keys``: runs of ``FAN`` at a
    time, then runs of these, so no task ever lists more.  Gives keys and ``v``."""
    out = parts.select(*keys, F.col(order).alias("n"), value.alias("v"))
    while True:
        listed = out.groupBy(*keys, F.expr(f"n div {FAN}").alias("n")).agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("parts"))
        out, most = listed.select(*keys, "n", fold(F.col("parts")["v"]).alias("v")), -(-most // FAN)
        if most <= 1:
            return out.select(*keys, "v")


def _from_first(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold an array that isn't empty, starting from its first element."""
    return F.aggregate(F.slice(values, 2, F.size(values)), values[0], step)


_WIDE = "decimal(38,0)"


def _sums(total: Column, lowest: Column, highest: Column) -> Column:
    return F.struct(total.cast(_WIDE).alias("s"), lowest.cast(_WIDE).alias("lo"), highest.cast(_WIDE).alias("hi"))


def _after(a: Column, b: Column) -> Column:
    """Sum, lowest and highest partial sum of one run after another; associative."""
    return _sums(a["s"] + b["s"], F.least(a["lo"], a["s"] + b["lo"]), F.greatest(a["hi"], a["s"] + b["hi"]))


def ordered_int_sum(array: NDArray, v: Column, dtype: str) -> DataFrame:
    """A checked sum in storage order within each block, then over blocks in their order.

    A run of cells is summarised by its sum and its lowest and highest partial sums; these compose in order, so pieces of
    a block are folded in a tree, and so are blocks.
    """
    low, high = (F.lit(x).cast(_WIDE) for x in _INTS[dtype])
    rows = array.df.select(array.block().alias("block"), array.physical().alias("at"), v.cast(_WIDE).alias("v"))
    one = lambda x: _sums(x, x, x)
    fold = lambda values: _from_first(values, _after)
    blocks = _in_order(rows, ["block"], "at", one(F.col("v")), fold, array.cells)
    # blocks keep to their own limits, and so do the sums of the blocks so far
    inside = blocks.select("block", F.col("v.s").alias("s"), ((F.col("v.lo") >= low) & (F.col("v.hi") <= high)).alias("ok"))
    both = F.struct(one(F.col("s")).alias("t"), F.col("ok"))
    together = lambda a, b: F.struct(_after(a["t"], b["t"]).alias("t"), (a["ok"] & b["ok"]).alias("ok"))
    whole = _in_order(inside.withColumn("all", F.lit(0)), ["all"], "block", both, lambda values: _from_first(values, together), array.layout.grid.size)
    # of no cells the sum is 0
    out = whole.agg(F.max("v").alias("v")).select(F.coalesce("v.t.s", F.lit(0).cast(_WIDE)).alias("s"), F.coalesce(F.col("v.ok") & (F.col("v.t.lo") >= low) & (F.col("v.t.hi") <= high), F.lit(True)).alias("ok"))
    return out.select(F.when(F.col("ok"), F.col("s")).otherwise(F.raise_error(F.lit(OVERFLOW)).cast(_WIDE)).cast(DTYPES[dtype]).alias("value"))


def _sum_of(array: NDArray, v: Column, dtype: str, checked: str = "ordered") -> DataFrame:
    """Sum of a column of the array's table."""
    df = array.df
    if not _is_float(dtype) and checked == "ordered":
        return ordered_int_sum(array, v, dtype)
    if dtype.startswith("c"):
        return df.agg(F.struct(float_sum(v["re"]).cast(DTYPES[dtype]).alias("re"), float_sum(v["im"]).cast(DTYPES[dtype]).alias("im")).alias("value"))
    out = float_sum(v).cast(DTYPES[dtype]) if _is_float(dtype) else int_sum(v, dtype)
    return df.agg(out.alias("value"))


def global_sum(array: NDArray, checked: str = "ordered") -> DataFrame:
    if array.dtype == "bool":
        raise ReductionError("truth values have no sum")
    if _is_float(array.dtype):
        return _sum_of(array, array.value, array.dtype)
    return _sum_of(array, F.col("v"), array.dtype, checked)


def _extreme(v: Column, pick: Callable, dtype: str) -> Column:
    if dtype[0] in "cb":
        raise ReductionError(f"{dtype} has no order")
    return F.when(F.coalesce(F.bool_or(F.isnan(v)), F.lit(False)), F.lit(float("nan")).cast(DTYPES[dtype])).otherwise(pick(v)) if _is_float(dtype) else pick(v)


def global_min(array: NDArray) -> DataFrame:
    return array.df.agg(_extreme(F.col("v"), F.min, array.dtype).alias("value"))


def global_max(array: NDArray) -> DataFrame:
    return array.df.agg(_extreme(F.col("v"), F.max, array.dtype).alias("value"))


def _magnitude(v: Column, dtype: str) -> Column:
    return F.hypot(v["re"].cast("double"), v["im"].cast("double")) if dtype.startswith("c") else F.abs(v.cast("double"))


def _norm_of(df: DataFrame, v: Column, dtype: str) -> DataFrame:
    kind = "float" if dtype in ("f32", "c64") else "double"
    parts = [v["re"], v["im"]] if dtype.startswith("c") else [v]
    nan, infinite = F.lit(False), F.lit(False)
    for p in parts:
        nan, infinite = nan | F.isnan(p.cast("double")), infinite | (F.abs(p.cast("double")) == _INF)
    sums = df.agg(F.coalesce(F.bool_or(nan), F.lit(False)).alias("nan"), F.coalesce(F.bool_or(infinite), F.lit(False)).alias("infinite"), *squares(parts, "n"))
    return sums.select(F.when(F.col("nan"), F.lit(float("nan"))).when(F.col("infinite"), F.lit(_INF)).otherwise(norm_of("n")).cast(kind).alias("value"))


def l2_norm(array: NDArray) -> DataFrame:
    return _norm_of(array.df, array.value, array.dtype)


def truth(v: Column, dtype: str) -> Column:
    if dtype == "bool":
        return v
    return (v["re"] != 0) | (v["im"] != 0) if dtype.startswith("c") else v != 0


def any_(array: NDArray) -> DataFrame:
    return any_by(array, lambda v: truth(v, array.dtype))


def all_(array: NDArray) -> DataFrame:
    return all_by(array, lambda v: truth(v, array.dtype))


def any_by(array: NDArray, predicate: Callable[[Column], Column]) -> DataFrame:
    return array.df.agg(F.coalesce(F.bool_or(predicate(array.value)), F.lit(False)).alias("value"))


def all_by(array: NDArray, predicate: Callable[[Column], Column]) -> DataFrame:
    return array.df.agg(F.coalesce(F.bool_and(predicate(array.value)), F.lit(True)).alias("value"))


def sum_by(array: NDArray, f: Callable[[Column], Column], dtype: str | None = None, checked: str = "ordered") -> DataFrame:
    return _sum_of(array, f(array.value), dtype or array.dtype, checked)


def norm_by(array: NDArray, f: Callable[[Column], Column], dtype: str | None = None) -> DataFrame:
    return _norm_of(array.df.select(f(array.value).alias("w")), F.col("w"), dtype or array.dtype)


def min_by(array: NDArray, f: Callable[[Column], Column], dtype: str | None = None) -> DataFrame:
    """The smallest f(v): not SQL's arg-min."""
    return array.df.agg(_extreme(f(array.value), F.min, dtype or array.dtype).alias("value"))


def max_by(array: NDArray, f: Callable[[Column], Column], dtype: str | None = None) -> DataFrame:
    return array.df.agg(_extreme(f(array.value), F.max, dtype or array.dtype).alias("value"))


def _zip(arrays: Sequence[NDArray]) -> NDArray:
    """The inputs side by side, as ``a0``, ``a1`` and so on, under the coordinates that they have in common."""
    if not arrays:
        raise ReductionError("an input is needed")
    extra = batch_shape(arrays, ReductionError)
    blank = [F.lit(None).cast(DTYPES[arrays[0].dtype]).alias(v) for v in arrays[0].values]
    return arrays[0].with_df(aligned(arrays, extra).select("*", *blank), extra=extra)


def zip_sum_by(a: NDArray, b: NDArray, f: Callable[[Column, Column], Column], dtype: str | None = None, checked: str = "ordered") -> DataFrame:
    """Sum of f over two arrays whose batch axes expand both ways."""
    return _sum_of(_zip([a, b]), f(F.col("a0"), F.col("a1")), dtype or a.dtype, checked)


def zip_norm_by(a: NDArray, b: NDArray, f: Callable[[Column, Column], Column], dtype: str | None = None) -> DataFrame:
    return _norm_of(_zip([a, b]).df.select(f(F.col("a0"), F.col("a1")).alias("w")), F.col("w"), dtype or a.dtype)


def _many(arrays: Sequence[NDArray]) -> NDArray:
    """The inputs' values as one array column ``values``."""
    if any(a.dtype != arrays[0].dtype for a in arrays):
        raise ReductionError("the inputs differ in type")
    side = _zip(arrays)
    return side.with_df(side.df.withColumn("values", F.array(*[f"a{m}" for m in range(len(arrays))])))


def sum_many_by(arrays: Sequence[NDArray], f: Callable[[Column], Column], dtype: str | None = None, checked: str = "ordered") -> DataFrame:
    return _sum_of(_many(arrays), f(F.col("values")), dtype or arrays[0].dtype, checked)


def norm_many_by(arrays: Sequence[NDArray], f: Callable[[Column], Column], dtype: str | None = None) -> DataFrame:
    return _norm_of(_many(arrays).df.select(f(F.col("values")).alias("w")), F.col("w"), dtype or arrays[0].dtype)


def min_many_by(arrays: Sequence[NDArray], f: Callable[[Column], Column], dtype: str | None = None) -> DataFrame:
    return _many(arrays).df.agg(_extreme(f(F.col("values")), F.min, dtype or arrays[0].dtype).alias("value"))


def max_many_by(arrays: Sequence[NDArray], f: Callable[[Column], Column], dtype: str | None = None) -> DataFrame:
    return _many(arrays).df.agg(_extreme(f(F.col("values")), F.max, dtype or arrays[0].dtype).alias("value"))


#: Reducers that Spark aggregates natively (with these no order is kept, as none is needed), and what they do to two values.
NATIVE = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "product": (F.product, lambda a, b: a * b),
    "and": (F.bool_and, lambda a, b: a & b),
    "or": (F.bool_or, lambda a, b: a | b),
}


def _with_neutral(blocks: DataFrame, count: int, neutral: Column, reduce: str | Callable[[Column, Column], Column], kind: str) -> DataFrame:
    """One row from ``blocks`` (block, v): ``neutral`` before each of ``count`` blocks, empty ones too, and before all."""
    step = NATIVE[reduce][1] if isinstance(reduce, str) else reduce
    every = blocks.sparkSession.range(count).withColumnRenamed("id", "block").join(blocks, "block", "left")
    each = every.select("block", F.when(F.col("v").isNull(), neutral).otherwise(step(neutral, F.col("v"))).cast(kind).alias("v"))
    if isinstance(reduce, str):
        whole = each.agg(NATIVE[reduce][0]("v").alias("v"))
    else:
        whole = _in_order(each.withColumn("all", F.lit(0)), ["all"], "block", F.col("v"), lambda values: _from_first(values, lambda a, b: step(a, b).cast(kind)), count)
    return whole.select(step(neutral, F.col("v")).cast(kind).alias("value"))


def map_reduce(arrays: Sequence[NDArray | Tiles], neutral, f: Callable[..., Column], reduce: str | Callable[[Column, Column], Column], kind: str = "double") -> DataFrame:
    """Map aligned values and reduce them: a native reducer by name, or an associative function.

    The rule for ``neutral``: every block is folded in storage order starting from ``neutral`` (an empty block is
    ``neutral``), and so are the blocks' results in the order of the blocks.  A neutral value that is no identity of the
    reducer therefore counts once for each block and once more, whatever the size of the array or of its pieces.

    A function is folded in storage order within runs of a block, then over runs of these, and over blocks, so that it
    need not commute; no task holds more than ``FAN`` results.  Arrays of tiles are folded where they are: a tile is a
    block, and only its result moves.
    """
    if not arrays:
        raise ReductionError("an input is needed")
    start, first = F.lit(neutral).cast(kind), arrays[0]
    step = NATIVE[reduce][1] if isinstance(reduce, str) else reduce
    typed = lambda a, b: step(a, b).cast(kind)
    if isinstance(first, Tiles):
        tiles = first.pointwise(f, *arrays[1:], kind=kind)
        blocks = tiles.df.select(F.col("block_id").alias("block"), _from_first(F.col("v"), typed).alias("v"))
        return _with_neutral(blocks, math.prod(first.tiling.counts), start, reduce, kind)
    extra = batch_shape(arrays, ReductionError)
    mapped = f(*[F.col(f"a{m}") for m in range(len(arrays))])
    like = first.with_df(aligned(arrays, extra).select(*first.coords, mapped.cast(kind).alias("v"), *([F.lit(0.0).alias("re"), F.lit(0.0).alias("im")] if first.complex else [])), extra=extra)
    rows = like.df.select(like.block().alias("block"), like.physical().alias("at"), "v")
    if isinstance(reduce, str):
        blocks = rows.groupBy("block").agg(NATIVE[reduce][0]("v").cast(kind).alias("v"))
    else:
        blocks = _in_order(rows, ["block"], "at", F.col("v"), lambda values: _from_first(values, typed), like.cells)
    return _with_neutral(blocks, first.layout.grid.size, start, reduce, kind)


def map_reduce_many(arrays: Sequence[NDArray], neutral, f: Callable[[Column], Column], reduce, kind: str = "double") -> DataFrame:
    """As ``map_reduce``, with f of an array column that holds the inputs' values in order."""
    return map_reduce(arrays, neutral, lambda *v: f(F.array(*v)), reduce, kind)


def gather(array: NDArray, root: int = 0) -> DataFrame:
    """All cells in logical row-major order, with their ``offset``, for one block of the grid to collect."""
    if not 0 <= root < array.layout.grid.size:
        raise ReductionError(f"there is no block {root}")
    return array.gather()


def agreed(flags: DataFrame, ok: str = "ok") -> DataFrame:
    """Whether every block reports success; true for no blocks."""
    return flags.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("value"))
