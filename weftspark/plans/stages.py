"""Run one-axis steps over a cell table, several axes in one exchange where that is possible.

Steps on neighbouring selected axes share a stage: the table is dealt by the other coordinates, sorted inside each
partition, and every group (a line or slab) is one contiguous run of rows that numpy transforms in a batch.  Axes that
are not selected cost nothing.  A stage takes an axis in as long as a slab stays under ``SLAB_CELLS`` and enough
groups remain to keep a cluster busy.

A line is transformed by one task, up to ``LINE_CELLS``.  Longer Fourier lines are split: n = n1 n2 makes the axis two
axes, with a factor for each cell between the transforms of the one and of the other, so that two exchanges and tasks of
n1 and n2 cells do what one task of n would.  Lines of prime length are convolutions with a chirp, which are made of
transforms of a power of two.  Real lines of even length are split as complex lines of half their length, and Hartley and
real-to-real ones are made of these, or of complex lines of the same length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from ..errors import TransformError
from ..functions import kernels
from ..functions.kernels import Step
from ..operators.array import DTYPES, NDArray
from ..operators.norms import norm_of, squares
from . import lines
from .layout import Layout

#: Cells of the largest slab, cells of an array that may be one slab, groups wanted beside that, and cells of a line
#: from which on it is split.
SLAB_CELLS, SMALL_CELLS, GROUPS, LINE_CELLS = 1 << 22, 1 << 16, 256, 1 << 22

#: Tables after each stage of the transform that is being built, where somebody wants to know them.
stages_seen: ContextVar[list[tuple[tuple[int, ...], DataFrame]] | None] = ContextVar("stages_seen", default=None)


@dataclass(frozen=True)
class Tuning:
    """Sizes at which stages are cut; None takes the module's."""

    slab_cells: int | None = None
    small_cells: int | None = None
    line_cells: int | None = None

    @property
    def slab(self) -> int:
        return SLAB_CELLS if self.slab_cells is None else self.slab_cells

    @property
    def small(self) -> int:
        return SMALL_CELLS if self.small_cells is None else self.small_cells

    @property
    def line(self) -> int:
        return LINE_CELLS if self.line_cells is None else self.line_cells


def stage_axes(extents: list[int], cells: int, tuning: Tuning = Tuning()) -> list[int]:
    """How many of the steps' axes (extents in order) go into each stage."""
    out, size = [], 0
    for n in extents:
        joined = size * n
        if size and joined <= tuning.slab and (cells <= tuning.small or cells // joined >= GROUPS):
            out[-1] += 1
            size = joined
        else:
            out.append(1)
            size = n
    return out


def _run(steps: list[Step], axes: list[int], shape: list[int], keys: int, real_in: bool, scale: float, names: list[str], types: list[pa.DataType]):
    """A function over Arrow batches: columns are ``keys`` key coordinates, the axes' coordinates, then values."""
    cells = math.prod(shape)

    def transform(columns: list[np.ndarray]) -> pa.RecordBatch:
        groups = len(columns[0]) // cells
        for k in range(keys):
            one = columns[k].reshape(groups, cells)
            if (one != one[:, :1]).any():
                raise TransformError("TransformError: the array isn't dense: a line is incomplete")
        want = np.indices(shape).reshape(len(shape), cells)
        for a in range(len(axes)):
            if (columns[keys + a].reshape(groups, cells) != want[a]).any():
                raise TransformError("TransformError: the array isn't dense: a cell is missing or twice there")
        v = columns[keys + len(axes) :]
        x = (v[0] if real_in else v[0] + 1j * v[1]).reshape(groups, *shape)
        for step in steps:
            x = kernels.apply(step, x, 1 + axes.index(step[1]))
        if scale != 1.0:
            x = x * scale
        per = math.prod(x.shape[1:])
        out = [np.repeat(columns[k].reshape(groups, cells)[:, 0], per) for k in range(keys)]
        out += [np.tile(c, groups) for c in np.indices(x.shape[1:]).reshape(len(axes), per)]
        flat = x.reshape(-1)
        out += [flat.real, flat.imag] if np.iscomplexobj(flat) else [flat]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), t) for c, t in zip(out, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        at_once = max(cells, (1 << 18) // cells * cells)
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= at_once:
                whole = [np.concatenate(c) for c in zip(*held, strict=True)]
                end = n // cells * cells
                yield transform([c[:end] for c in whole])
                held, n = [[c[end:] for c in whole]], n - end
        if n:
            if n % cells:
                raise TransformError("TransformError: the array isn't dense: a line is incomplete")
            yield transform([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _becomes_complex(complex_: bool, steps: list[Step]) -> bool:
    for s in steps:
        if s[0] in ("rfft", "crfft"):
            complex_ = s[0] == "rfft"
    return complex_


def _dtype(array: NDArray, complex_: bool) -> str:
    wide = array.dtype in ("f64", "c128")
    return ("c128" if wide else "c64") if complex_ else ("f64" if wide else "f32")


def scaled(array: NDArray, scale: float) -> NDArray:
    values = [(F.col(v) * F.lit(scale)).cast(DTYPES[array.dtype]).alias(v) for v in array.values] if scale != 1.0 else array.values
    return array.with_df(array.df.select(*array.coords, *values))


def apply_steps(array: NDArray, steps: list[Step], shape_after: dict[int, int], complex_after: bool, scale: float = 1.0, tuning: Tuning = Tuning()) -> NDArray:
    """Apply ``steps`` in order.  ``shape_after`` gives extents that change, ``complex_after`` the kind of the result.

    A step that makes a real array complex or back must be the first or the last of all.
    """
    ship(array.df.sparkSession)
    if _becomes_complex(array.complex, steps) != complex_after:
        raise TransformError("the steps don't lead to the kind of result that was asked for")
    for n, step in enumerate(steps):
        if max(array.shape[step[1]], shape_after.get(step[1], 0) if step[0] == "crfft" else 0) > max(tuning.line, 3):
            before = _staged(array, steps[:n], shape_after, 1.0, tuning)
            if (long := _long_step(before, step, shape_after, tuning)) is not None:
                return apply_steps(long, steps[n + 1 :], shape_after, complex_after, scale, tuning)
    return _staged(array, steps, shape_after, scale, tuning)


def _staged(array: NDArray, steps: list[Step], shape_after: dict[int, int], scale: float, tuning: Tuning) -> NDArray:
    if not steps:
        return scaled(array, scale)
    shape = list(array.shape)
    df, is_real = array.table(), not array.complex
    df = df.select(*array.coords, *[F.col(v).cast("double").alias(v) for v in array.values])
    at = 0
    counts = stage_axes([max(shape[s[1]], shape_after.get(s[1], 0)) for s in steps], array.cells, tuning)
    for done, count in enumerate(counts):
        mine = steps[at : at + count]
        at += count
        last = done == len(counts) - 1
        axes = sorted({s[1] for s in mine})
        keys = [*array.batch, *(f"i{k}" for k in range(array.rank) if k not in axes)]
        local = [f"i{k}" for k in axes]
        becomes_real = not _becomes_complex(not is_real, mine)
        out_values = ["v"] if becomes_real else ["re", "im"]
        names = [*keys, *local, *out_values]
        types = [pa.int64()] * (len(keys) + len(local)) + [pa.float64()] * len(out_values)
        in_values = ["v"] if is_real else ["re", "im"]
        dealt = df.repartition(*keys) if keys else df.repartition(1)
        dealt = dealt.sortWithinPartitions(*keys, *local).select(*keys, *local, *in_values)
        run = _run(mine, axes, [shape[k] for k in axes], len(keys), is_real, scale if last else 1.0, names, types)
        schema = ", ".join(f"{c} {'long' if t == pa.int64() else 'double'}" for c, t in zip(names, types, strict=True))
        df = dealt.mapInArrow(run, schema)
        if (seen := stages_seen.get()) is not None:
            seen.append((tuple(s[1] for s in mine), df))
        for s in mine:
            if s[0] in ("rfft", "crfft"):
                shape[s[1]] = shape_after[s[1]]
        is_real = becomes_real
    dtype = _dtype(array, not is_real)
    values = [F.col(v).cast(DTYPES[dtype]).alias(v) for v in (["v"] if is_real else ["re", "im"])]
    return array.with_df(df.select(*array.coords, *values), layout=array.layout.with_shape(tuple(shape)), dtype=dtype)


def _factors(n: int) -> tuple[int, int] | None:
    """The two most even factors, if ``n`` has any."""
    n1 = next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)
    return (n1, n // n1) if n1 > 1 else None


def _long_step(array: NDArray, step: Step, shape_after: dict[int, int], tuning: Tuning) -> NDArray | None:
    """A step along an axis whose lines are too long for a task, in several stages; None if they aren't too long."""
    name, axis, parameter = step
    n = shape_after[axis] if name == "crfft" else array.shape[axis]
    if n <= max(tuning.line, 3):
        return None
    if name == "fft":
        return _long_fft(array, axis, parameter, tuning)
    if array.complex and name != "crfft":
        return _by_parts(array, lambda a: _long_step(a, step, shape_after, tuning))
    if name in kernels.R2R_KINDS:
        return _long_r2r(array, name, axis, tuning)
    if name == "dht":
        return _mirrored(_long_rfft(array, axis, -1, tuning), array, axis, lambda re, im: (re - im, re + im), array.dtype)
    return _long_rfft(array, axis, parameter, tuning) if name == "rfft" else _long_crfft(array, axis, n, 1 if parameter > 0 else -1, tuning)


def _typed(df: DataFrame, array: NDArray, axis: int, extent: int, dtype: str) -> NDArray:
    """A table of values in double as an array like ``array`` with another extent and type."""
    shape = tuple(extent if k == axis else m for k, m in enumerate(array.shape))
    values = ["re", "im"] if dtype.startswith("c") else ["v"]
    return array.with_df(df.select(*[F.col(c).cast("long").alias(c) for c in array.coords], *[F.col(v).cast(DTYPES[dtype]).alias(v) for v in values]), layout=array.layout.with_shape(shape), dtype=dtype)


def _by_parts(array: NDArray, f: Callable[[NDArray], NDArray]) -> NDArray:
    """A real transform of both parts of a complex array, as one more batch axis."""
    up = {f"x{k}": f"x{k + 1}" for k in range(len(array.extra))}
    part = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("p"), F.col(v).alias("v")) for i, v in enumerate(array.values)])).alias("_part")
    df = array.table().select(*array.coords, part).withColumnsRenamed(up).select("*", F.col("_part.p").alias("x0"), F.col("_part.v").alias("v"))
    out = f(NDArray(df, array.layout, (2, *array.extra), "f64" if array.dtype == "c128" else "f32"))
    down = out.df.withColumnRenamed("x0", "_p").withColumnsRenamed({new: old for old, new in up.items()})
    joined = down.groupBy(*array.coords).agg(*[F.max(F.when(F.col("_p") == i, F.col("v"))).alias(v) for i, v in enumerate(array.values)])
    return array.with_df(joined, layout=array.layout.with_shape(out.shape))


def _dealt(df: DataFrame, keys: list[str], local: list[str], values: list[str], work: Callable[[list[np.ndarray]], list[np.ndarray]], names: list[str], axis: int) -> DataFrame:
    """One exchange: whole groups of ``keys``, sorted by ``local``, through ``work``; values are the last names."""
    made = len(names) - (2 if names[-1] == "im" else 1)
    schema = ", ".join(f"{c} {'long' if k < made else 'double'}" for k, c in enumerate(names))
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *local).select(*keys, *local, *values)
    out = rows.mapInArrow(lines.by_groups(len(keys), work, names), schema)
    if (seen := stages_seen.get()) is not None:
        seen.append(((axis,), out))
    return out


def _long_fft(array: NDArray, axis: int, sign: int, tuning: Tuning) -> NDArray:
    """Index n2 a + b becomes c + n1 d, if the length has factors; else the line is a convolution."""
    n, c = array.shape[axis], f"i{axis}"
    if (parts := _factors(n)) is None:
        return _chirped(array, axis, sign, tuning)
    n1, n2 = parts
    later = {f"i{k}": f"i{k + 1}" for k in range(axis + 1, array.rank)}
    names = [x for x in array.coords if x != c]
    shape = (*array.shape[:axis], n1, n2, *array.shape[axis + 1 :])
    df = array.table().select(*[F.col(x).alias(later.get(x, x)) for x in names], F.expr(f"{c} div {n2}").alias(c), (F.col(c) % n2).alias(f"i{axis + 1}"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    two = apply_steps(NDArray(df, Layout.of(shape), array.extra, "c128"), [("fft", axis, sign)], {}, True, 1.0, tuning)
    turn = F.lit(sign * 2 * math.pi / n) * ((F.col(c) * F.col(f"i{axis + 1}")) % n)
    two = apply_steps(two.with_df(two.df.select(*two.coords, *_turned(turn))), [("fft", axis + 1, sign)], {}, True, 1.0, tuning)
    df = two.df.select(*[F.col(later.get(x, x)).alias(x) for x in names], (F.col(c) + n1 * F.col(f"i{axis + 1}")).alias(c), "re", "im")
    return _typed(df, array, axis, n, array.dtype)


def _turned(angle: Column, re: Column | None = None, im: Column | None = None) -> list[Column]:
    """re and im times exp(i angle)."""
    re, im = F.col("re") if re is None else re, F.col("im") if im is None else im
    return [(re * F.cos(angle) - im * F.sin(angle)).alias("re"), (im * F.cos(angle) + re * F.sin(angle)).alias("im")]


def _chirp(j: Column, n: int, sign: int) -> Column:
    """The angle sign pi j**2 / n."""
    return F.lit(sign * math.pi / n) * ((j * j) % (2 * n))


def _chirped(array: NDArray, axis: int, sign: int, tuning: Tuning) -> NDArray:
    """A line of prime length: times a chirp, convolved with the chirp's conjugate, times the chirp (chirp-z).

    The convolution is a product of transforms of ``m`` cells, a power of two, which are split as any long line.
    """
    n, c = array.shape[axis], f"i{axis}"
    m = 1 << (2 * n - 2).bit_length()
    names = [x for x in array.coords if x != c]
    cells = F.concat(F.array(F.col(c)), F.filter(F.sequence(F.lit(n) + F.col(c), F.greatest(F.lit(n) + F.col(c), F.lit(m - 1).cast("long")), F.lit(n).cast("long")), lambda z: z < m))
    own = F.col("_at") == F.col(c)
    filled = array.table().select(*array.coords, *_turned(_chirp(F.col(c), n, sign), F.col("re").cast("double"), F.col("im").cast("double")), F.explode(cells).alias("_at"))
    filled = filled.select(*names, *[F.when(own, F.col(v)).otherwise(F.lit(0.0)).alias(v) for v in ("re", "im")], F.col("_at").alias(c))
    shape = tuple(m if k == axis else x for k, x in enumerate(array.shape))
    a = apply_steps(NDArray(filled, Layout.of(shape), array.extra, "c128"), [("fft", axis, -1)], {}, True, 1.0, tuning)
    near = F.least(F.col("i0"), m - F.col("i0"))
    ring = NDArray.grid(array.df.sparkSession, Layout.of((m,)))
    ring = ring.select("i0", *[F.when(near < n, x).otherwise(F.lit(0.0)).alias(v) for v, x in (("re", F.cos(_chirp(near, n, sign))), ("im", -F.sin(_chirp(near, n, sign))))])
    b = apply_steps(NDArray(ring, Layout.of((m,)), (), "c128"), [("fft", 0, -1)], {}, True, 1.0, tuning)
    other = b.df.select(F.col("i0").alias(c), F.col("re").alias("_re"), F.col("im").alias("_im"))
    product = a.df.join(other, c).select(*a.coords, (F.col("re") * F.col("_re") - F.col("im") * F.col("_im")).alias("re"), (F.col("re") * F.col("_im") + F.col("im") * F.col("_re")).alias("im"))
    out = apply_steps(a.with_df(product), [("fft", axis, 1)], {}, True, 1.0 / m, tuning)
    return _typed(out.df.filter(F.col(c) < n).select(*out.coords, *_turned(_chirp(F.col(c), n, sign))), array, axis, n, array.dtype)


def _long_rfft(array: NDArray, axis: int, sign: int, tuning: Tuning) -> NDArray:
    """The half spectrum of long real lines: of even ones by complex lines of half their length."""
    n, c, dtype = array.shape[axis], f"i{axis}", _dtype(array, True)
    names = [x for x in array.coords if x != c]
    parts = _factors(n // 2) if n % 2 == 0 else None
    if parts is None or 2 * parts[1] > tuning.line:
        whole = array.table().select(*array.coords, F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
        out = apply_steps(NDArray(whole, array.layout, array.extra, "c128"), [("fft", axis, sign)], {}, True, 1.0, tuning)
        return _typed(out.df.filter(F.col(c) <= n // 2), array, axis, n // 2 + 1, dtype)
    n1, n2 = parts
    j = F.expr(f"{c} div 2")
    df = array.table().select(*names, (j % n2).alias("_b"), (2 * F.expr(f"({c} div 2) div {n2}") + F.col(c) % 2).alias("_a"), F.col("v").cast("double").alias("v"))
    k = len(names)
    df = _dealt(df, [*names, "_b"], ["_a"], ["v"], lambda x: lines.pack(x, k + 1, n1, n // 2), [*names, "_b", "_c", "re", "im"], axis)
    df = df.withColumn("_g", F.least("_c", n1 - F.col("_c")))
    df = _dealt(df.withColumn("_g", F.when(F.col("_c") == 0, F.lit(0).cast("long")).otherwise(F.col("_g"))), [*names, "_g"], ["_c", "_b"], ["re", "im"], lambda x: lines.unpack(x, k + 1, n1, n2, sign), [*names, c, "re", "im"], axis)
    return _typed(df, array, axis, n // 2 + 1, dtype)


def _long_crfft(array: NDArray, axis: int, n: int, sign: int, tuning: Tuning) -> NDArray:
    """Real lines from their long half spectra; imaginary parts of the first and, if ``n`` is even, last cell are 0."""
    c, dtype = f"i{axis}", _dtype(array, False)
    names = [x for x in array.coords if x != c]
    parts = _factors(n // 2) if n % 2 == 0 else None
    if parts is None or 2 * parts[1] > tuning.line:
        own = (F.col(c) == 0) | (2 * F.col(c) == n)
        cell = lambda i, im: F.struct(i.alias("i"), im.alias("im"))
        both = F.when(own, F.array(cell(F.col(c), F.lit(0.0)))).otherwise(F.array(cell(F.col(c), F.col("im").cast("double")), cell(n - F.col(c), -F.col("im").cast("double"))))
        df = array.table().withColumn("_to", F.explode(both)).select(*names, F.col("re").cast("double").alias("re"), F.col("_to.i").alias(c), F.col("_to.im").alias("im"))
        shape = tuple(n if k == axis else m for k, m in enumerate(array.shape))
        out = apply_steps(NDArray(df, Layout.of(shape), array.extra, "c128"), [("fft", axis, sign)], {}, True, 1.0, tuning)
        return _typed(out.df.withColumnRenamed("re", "v"), array, axis, n, dtype)
    n1, n2 = parts
    last = 2 * F.col(c) == n
    df = array.table().select(*names, F.when(last, F.lit(0).cast("long")).otherwise(F.col(c) % n2).alias("_b"), F.expr(f"{c} div {n2}").alias("_a"), *[F.col(v).cast("double").alias(v) for v in ("re", "im")])
    df = df.withColumn("_g", F.when(F.col("_b") == 0, F.lit(0).cast("long")).otherwise(F.least("_b", n2 - F.col("_b"))))
    k = len(names)
    df = _dealt(df, [*names, "_g"], ["_b", "_a"], ["re", "im"], lambda x: lines.back(x, k + 1, n1, n2, sign), [*names, "_c", "_b", "re", "im"], axis)
    df = _dealt(df, [*names, "_c"], ["_b"], ["re", "im"], lambda x: lines.unfold(x, k + 1, n1, n2), [*names, c, "v"], axis)
    return _typed(df, array, axis, n, dtype)


def _mirrored(half: NDArray, array: NDArray, axis: int, values: Callable[[Column, Column], tuple[Column, Column]], dtype: str) -> NDArray:
    """Real cells k and n - k from cell k of a half spectrum: ``values`` gives both."""
    n, c = array.shape[axis], F.col(f"i{axis}")
    here, there = values(F.col("re").cast("double"), F.col("im").cast("double"))
    cell = lambda i, v: F.struct(i.alias("i"), v.alias("v"))
    both = F.when((c == 0) | (2 * c == n), F.array(cell(c, here))).otherwise(F.array(cell(c, here), cell(n - c, there)))
    names = [x for x in half.coords if x != f"i{axis}"]
    df = half.df.select(*names, F.explode(both).alias("_to")).select(*names, F.col("_to.i").alias(f"i{axis}"), F.col("_to.v").alias("v"))
    return _typed(df, array, axis, n, dtype)


def _long_r2r(array: NDArray, kind: str, axis: int, tuning: Tuning) -> NDArray:
    """A real-to-real kind along an axis of long real lines, by Fourier transforms of about their length.

    The kernels' ways, with the reordering of cells as a projection.  dct1 and dst1 are half spectra of symmetric lines.
    """
    n, c = array.shape[axis], f"i{axis}"
    i, names, v = F.col(c), [x for x in array.coords if x != c], F.col("v").cast("double")
    if kind in ("dst2", "dst3", "dst4"):
        # the cosine kind of the line with alternating signs, or of the reversed one
        turn = lambda x, flip: x.df.select(*names, (n - 1 - i if flip else i).alias(c), (F.col("v") * (F.lit(1) if flip else F.expr(f"1 - 2 * ({c} % 2)"))).alias("v"))
        cosine = _long_r2r(_typed(turn(array, kind != "dst2"), array, axis, n, array.dtype), kind.replace("s", "c"), axis, tuning)
        return _typed(turn(cosine, kind == "dst2"), array, axis, n, array.dtype)
    if kind in ("dct1", "dst1"):
        m, odd = kernels.embedding_length(kind, n), int(kind == "dst1")
        cell = lambda p, f: F.struct(p.cast("long").alias("p"), f.alias("f"))
        places = [cell(i + odd, v), cell(m - i - odd, -v if odd else v)]
        cells = F.array(*places) if odd else F.when((i == 0) | (i == n - 1), F.array(places[0])).otherwise(F.array(*places))
        if odd:  # the two cells that are 0 come with the first one
            cells = F.when(i == 0, F.concat(cells, F.array(*[cell(F.lit(z), F.lit(0.0)) for z in (0, n + 1)]))).otherwise(cells)
        long = array.table().select(*names, F.explode(cells).alias("_to")).select(*names, F.col("_to.p").alias(c), F.col("_to.f").alias("v"))
        half = apply_steps(_typed(long, array, axis, m, "f64"), [("rfft", axis, -1)], {axis: m // 2 + 1}, True, 1.0, tuning)
        df = half.df.filter(i.between(1, n)).select(*names, (i - 1).alias(c), (-F.col("im")).alias("v")) if odd else half.df.select(*names, c, F.col("re").alias("v"))
        return _typed(df, array, axis, n, array.dtype)
    evens = (n + 1) // 2
    if kind == "dct2":
        placed = array.table().select(*names, F.when(i % 2 == 0, F.expr(f"{c} div 2")).otherwise(n - 1 - F.expr(f"{c} div 2")).alias(c), v.alias("v"))
        half = apply_steps(_typed(placed, array, axis, n, "f64"), [("rfft", axis, -1)], {axis: n // 2 + 1}, True, 1.0, tuning)
        angle = F.lit(-math.pi / (2 * n)) * i
        return _mirrored(half, array, axis, lambda re, im: (2 * _turned(angle, re, im)[0], -2 * _turned(angle, re, im)[1]), array.dtype)
    # dct3 and dct4: complex lines, of whose transform the real part is wanted
    angle, share = (F.lit(math.pi / (2 * n)) * i, F.when(i == 0, 0.5).otherwise(1.0)) if kind == "dct3" else (F.lit(-math.pi / (2 * n)) * i, F.lit(1.0))
    turned = array.table().select(*array.coords, *_turned(angle, v * share, F.lit(0.0)))
    out = apply_steps(NDArray(turned, Layout.of(array.shape), array.extra, "c128"), [("fft", axis, 1 if kind == "dct3" else -1)], {}, True, 1.0, tuning)
    if kind == "dct3":
        df = out.df.select(*names, F.when(i < evens, 2 * i).otherwise(2 * (n - 1 - i) + 1).alias(c), (2 * F.col("re")).alias("v"))
    else:
        after = _turned(F.lit(-math.pi / (4 * n)) * (4 * i + 1))[0]
        df = out.df.select(*names, F.when(i < evens, 2 * i).otherwise(2 * (n - 1 - i) + 1).alias(c), (F.when(i < evens, 2.0).otherwise(-2.0) * after).alias("v"))
    return _typed(df, array, axis, n, array.dtype)


def ends(array: NDArray, axis: int, n: int) -> NDArray:
    """The planes of a half spectrum that must be real."""
    return array.with_df(array.table().filter(F.col(f"i{axis}").isin([0, n // 2] if n % 2 == 0 else [0])))


def plane_norms(array: NDArray, axis: int, n: int) -> DataFrame:
    """For each batch and each plane of a half spectrum that must be real: ``tall``, the largest imaginary part, ``re``
    and ``im``, the norms of both parts, and ``odd``, whether a value isn't finite; one aggregation."""
    big = F.greatest(F.abs(F.col("re")), F.abs(F.col("im")))
    odd = F.isnan("re") | F.isnan("im") | (big == float("inf"))
    sums = [F.max(F.abs(F.col("im"))).alias("tall"), F.bool_or(odd).alias("odd"), *squares(F.col("re"), "r"), *squares(F.col("im"), "i")]
    planes = ends(array, axis, n).df.groupBy(*array.batch, f"i{axis}").agg(*sums)
    return planes.select(*array.batch, f"i{axis}", "tall", "odd", norm_of("r").alias("re"), norm_of("i").alias("im"))


def is_real(absolute: float, relative: float):
    """Whether a row of ``plane_norms`` is real within rounding."""
    return ~F.col("odd") & ((F.col("tall") <= absolute) | (F.col("im") <= relative * F.col("re")))


def rejected(planes: NDArray, axis: int, n: int, relative: float, absolute: float) -> DataFrame:
    """One row: in ``bad`` how many planes aren't real within rounding."""
    passes = F.coalesce(is_real(absolute, relative), F.lit(False))
    return plane_norms(planes, axis, n).agg(F.coalesce(F.sum(F.when(passes, 0).otherwise(1)), F.lit(0)).alias("bad"))


def check_boundary(array: NDArray, planes: NDArray, axis: int, n: int, relative: float, absolute: float) -> NDArray:
    """Let a half spectrum through if its DC and, for even ``n``, Nyquist planes are real within rounding.

    A plane of a batch passes if all its values are finite and either the largest imaginary part is at most
    ``absolute`` or the imaginary norm is at most ``relative`` times the real norm; its imaginary parts become 0.
    ``planes`` holds these planes, computed from themselves alone, so the check costs the share of the array that they
    are.  It is a scalar subquery: the query that reads the result fails if any plane doesn't pass.
    """
    c = f"i{axis}"
    bad = rejected(planes, axis, n, relative, absolute)
    verdict = F.when(bad.scalar() > 0, F.raise_error(F.lit("InvalidSpectrum: a plane of the half spectrum that must be real isn't")).cast("double"))
    im = F.when(F.col(c).isin([0, n // 2] if n % 2 == 0 else [0]), F.lit(0.0)).otherwise(F.col("im"))
    kind = DTYPES[array.dtype]
    return array.with_df(array.df.select(*array.coords, F.coalesce(verdict, F.col("re").cast("double")).cast(kind).alias("re"), im.cast(kind).alias("im")))
