"""Dense arrays as tiles: a row holds one block of cells as arrays, so exchanges move values and hardly any coordinates.

A tile has ``block_id``, ``origin`` (its first cell) and ``extent`` over all axes, batch axes first, and ``v``, or ``re``
and ``im``, in row-major order.  A tiling is the extents of its tiles, of which the last along an axis may be shorter.
Between two tilings each tile is cut at the borders of the others and only these pieces are shuffled; a transform works
in the task that puts a tile together.  Lines longer than a task takes go by way of cells.

Values are doubles; arrays of single precision are rounded to it.  A tile that isn't complete is an error.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from ..errors import ArrayError, PointwiseError, TransformError
from ..functions import kernels
from ..functions.kernels import Step
from ..plans import stages
from ..plans.layout import Layout
from .array import DTYPES, NDArray, save_buckets

#: Cells of a tile, unless the lines of a stage need more.
TILE_CELLS = 1 << 20


@dataclass(frozen=True)
class Tiling:
    """Extents of an array and of its tiles."""

    dims: tuple[int, ...]
    chunk: tuple[int, ...]

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.dims, self.chunk, strict=True))

    def origin(self, block: int) -> tuple[int, ...]:
        out = []
        for n, c in zip(reversed(self.counts), reversed(self.chunk), strict=True):
            out.append(block % n * c)
            block //= n
        return tuple(reversed(out))

    def extent(self, origin: Sequence[int]) -> tuple[int, ...]:
        return tuple(min(c, n - o) for n, c, o in zip(self.dims, self.chunk, origin, strict=True))

    def block(self, origin: Sequence[int]) -> int:
        out = 0
        for o, c, n in zip(origin, self.chunk, self.counts, strict=True):
            out = out * n + o // c
        return out

    def pieces(self, origin: Sequence[int], extent: Sequence[int]) -> Iterator[tuple[int, tuple[slice, ...], tuple[int, ...]]]:
        """Where a block of cells falls: block, slices of the cells given, and their place in that block."""
        cuts = []
        for o, e, c in zip(origin, extent, self.chunk, strict=True):
            borders = [o, *range((o // c + 1) * c, o + e, c), o + e]
            cuts.append(list(itertools.pairwise(borders)))
        for cut in itertools.product(*cuts):
            yield self.block([a for a, _ in cut]), tuple(slice(a - o, b - o) for (a, b), o in zip(cut, origin, strict=True)), tuple(a % c for (a, _), c in zip(cut, self.chunk, strict=True))


def tiling_for(dims: Sequence[int], whole: Sequence[int] = (), cells: int = TILE_CELLS) -> Tiling:
    """Tiles of about ``cells`` cells that hold all of the axes in ``whole``."""
    chunk = [n if k in whole else 1 for k, n in enumerate(dims)]
    room = cells // max(1, math.prod(dims[k] for k in whole))
    for k in reversed(range(len(dims))):
        if k not in whole and room > 1:
            chunk[k] = max(1, min(dims[k], room))
            room //= chunk[k]
    return Tiling(tuple(dims), tuple(max(1, c) for c in chunk))


def _columns(complex_: bool) -> list[str]:
    return ["re", "im"] if complex_ else ["v"]


def _schema(names: Sequence[str]) -> str:
    return "block_id long, origin array<long>, extent array<int>, " + ", ".join(f"{v} array<double>" for v in names)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts), kind))


def _rows(ids: list[int], origins: list, extents: list, values: list[list[np.ndarray]], names: Sequence[str]) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), pa.array(origins, pa.list_(pa.int64())), pa.array(extents, pa.list_(pa.int32())), *(_lists(v, pa.float64()) for v in values)]
    return pa.RecordBatch.from_arrays(columns, ["block_id", "origin", "extent", *names])


def _cells_of(array: pa.Array, row: int) -> np.ndarray:
    """One row's values, without a copy of the others."""
    return array.slice(row, 1).flatten().to_numpy(zero_copy_only=False)


def _out(x: np.ndarray, single: bool) -> list[np.ndarray]:
    parts = [x.real, x.imag] if np.iscomplexobj(x) else [x]
    return [(p.astype(np.float32) if single else p).astype(np.float64).ravel() for p in parts]


def _packed(tiling: Tiling, names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows block, place in the block, values: to tiles."""

    def made(block: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        origin = tiling.origin(block)
        extent = tiling.extent(origin)
        if len(columns[0]) != math.prod(extent) or (columns[0] != np.arange(len(columns[0]))).any():
            raise TransformError("TransformError: the array isn't dense: a cell is missing or twice there")
        return _rows([block], [origin], [extent], [[np.asarray(c, float)] for c in columns[1:]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = np.flatnonzero(np.diff(columns[0])) + 1
            for a, b in itertools.pairwise([0, *cut.tolist(), len(columns[0])]):
                if a == b:
                    continue
                if block is not None and columns[0][a] != block:
                    yield made(block, [np.concatenate(c) for c in zip(*held, strict=True)])
                    held = []
                block = int(columns[0][a])
                held.append([c[a:b] for c in columns[1:]])
        if held:
            yield made(block, [np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def _cut(tiling: Tiling, names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tiles to pieces of the tiles of ``tiling``, whose ``origin`` is their place in the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                origin, extent = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                values = [_cells_of(batch.column(3 + i), row).reshape(extent) for i in range(len(names))]
                ids, at, sizes, parts = [], [], [], [[] for _ in names]
                for block, where, place in tiling.pieces(origin, extent):
                    ids.append(block)
                    at.append(place)
                    sizes.append(values[0][where].shape)
                    for held, v in zip(parts, values, strict=True):
                        held.append(v[where].ravel())
                yield _rows(ids, at, sizes, parts, names)

    return run


def _assembled(tiling: Tiling, names: Sequence[str], work: Callable[[np.ndarray], np.ndarray], after: Tiling, single: bool, names_after: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces sorted by block: put together, through ``work``, to tiles of ``after``, which is numbered alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, x, left = None, None, 0

        def done() -> pa.RecordBatch:
            if left:
                raise TransformError("TransformError: the array isn't dense: a tile is incomplete")
            y, origin = work(x), after.origin(block)
            return _rows([block], [origin], [y.shape], [[v] for v in _out(y, single)], names_after)

        for batch in batches:
            for row, here in enumerate(batch.column(0).to_pylist()):
                if here != block:
                    if block is not None:
                        yield done()
                    block, extent = here, tiling.extent(tiling.origin(here))
                    x, left = np.empty(extent, complex if len(names) == 2 else float), math.prod(extent)
                size = batch.column(2)[row].as_py()
                where = tuple(slice(o, o + e) for o, e in zip(batch.column(1)[row].as_py(), size, strict=True))
                v = [_cells_of(batch.column(3 + i), row).reshape(size) for i in range(len(names))]
                x[where] = v[0] + 1j * v[1] if len(v) == 2 else v[0]
                left -= v[0].size
        if block is not None:
            yield done()

    return run


@dataclass(frozen=True)
class Tiles:
    """A table of tiles and what it is a table of."""

    df: DataFrame
    layout: Layout
    tiling: Tiling
    extra: tuple[int, ...] = ()
    dtype: str = "f64"

    def __post_init__(self):
        if self.dtype not in ("f32", "f64", "c64", "c128"):
            raise ArrayError(f"tiles hold real or complex floating-point numbers, not {self.dtype}")
        if self.tiling.dims != (*self.extra, *self.layout.shape):
            raise ArrayError(f"the tiling is one of {self.tiling.dims}, the array is {self.extra} x {self.layout.shape}")

    @property
    def shape(self) -> tuple[int, ...]:
        return self.layout.shape

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def complex(self) -> bool:
        return self.dtype.startswith("c")

    @property
    def single(self) -> bool:
        return self.dtype in ("f32", "c64")

    @property
    def values(self) -> list[str]:
        return _columns(self.complex)

    @property
    def cells(self) -> int:
        return math.prod(self.tiling.dims)

    def with_df(self, df: DataFrame, **changes) -> Tiles:
        return replace(self, df=df, **changes)

    # to and from cells

    @classmethod
    def from_cells(cls, array: NDArray, chunk: Sequence[int] | None = None, cells: int = TILE_CELLS) -> Tiles:
        """One exchange of cells; after it only values are moved."""
        ship(array.df.sparkSession)
        dims = (*array.extra, *array.shape)
        tiling = Tiling(dims, tuple(chunk)) if chunk is not None else tiling_for(dims, cells=cells)
        if len(tiling.chunk) != len(dims) or any(c < 1 for c in tiling.chunk):
            raise ArrayError(f"{tiling.chunk} is no tiling of {dims}")
        block, place = "0L", "0L"
        for c, n, size, count in zip(array.coords, dims, tiling.chunk, tiling.counts, strict=True):
            block = f"({block}) * {count}L + {c} div {size}"
            place = f"({place}) * least({size}L, {n}L - ({c} div {size}) * {size}L) + {c} % {size}"
        rows = array.df.select(F.expr(block).alias("block_id"), F.expr(place).alias("place"), *[F.col(v).cast("double").alias(v) for v in array.values])
        sorted_ = rows.repartition("block_id").sortWithinPartitions("block_id", "place")
        return cls(sorted_.mapInArrow(_packed(tiling, array.values), _schema(array.values)), array.layout, tiling, array.extra, array.dtype)

    def to_cells(self) -> NDArray:
        """No exchange and no Python: each tile is exploded."""
        names = [*(f"x{k}" for k in range(len(self.extra))), *(f"i{k}" for k in range(self.rank))]
        cell = F.posexplode(F.arrays_zip(*self.values)).alias("_at", "_cell")
        df, out, stride = self.df.select("origin", "extent", cell), [], F.lit(1).cast("long")
        for k in reversed(range(len(names))):
            size = F.col("extent")[k].cast("long")
            out.append((F.col("origin")[k] + F.floor(F.col("_at") / stride).cast("long") % size).alias(names[k]))
            stride = stride * size
        values = [F.col(f"_cell.{v}").cast(DTYPES[self.dtype]).alias(v) for v in self.values]
        return NDArray(df.select(*reversed(out), *values), self.layout, self.extra, self.dtype)

    # one exchange

    def _through(self, tiling: Tiling, work: Callable[[np.ndarray], np.ndarray], after: Tiling, dtype: str) -> Tiles:
        names, names_after = self.values, _columns(dtype.startswith("c"))
        run = _assembled(tiling, names, work, after, dtype in ("f32", "c64"), names_after)
        rows = self.df.select("block_id", "origin", "extent", *names)
        if tiling == self.tiling:  # a tile is the one piece of itself
            pieces = rows.withColumn("origin", F.transform("origin", lambda _: F.lit(0).cast("long")))
        else:
            pieces = rows.mapInArrow(_cut(tiling, names), _schema(names)).repartition("block_id").sortWithinPartitions("block_id")
        layout = self.layout.with_shape(after.dims[len(self.extra) :])
        return replace(self, df=pieces.mapInArrow(run, _schema(names_after)), layout=layout, tiling=after, dtype=dtype)

    def retiled(self, tiling: Tiling) -> Tiles:
        if tiling.dims != self.tiling.dims:
            raise ArrayError(f"{tiling.dims} isn't {self.tiling.dims}")
        return self if tiling == self.tiling else self._through(tiling, lambda x: x, tiling, self.dtype)

    # arithmetic

    def pointwise(self, f: Callable[..., Column], *others: Tiles, kind: str | None = None) -> Tiles:
        """``f`` of the cells of real arrays of one tiling; a join on the block, without an exchange where all are saved
        by block.  ``kind`` is the Spark type of the results, if they are no cells of an array like these."""
        if any(o.tiling != self.tiling or o.complex for o in others) or self.complex:
            raise PointwiseError("tiles are combined if they are real and of one tiling")
        df, parts = self.df, ["v"]
        for n, o in enumerate(others):
            df = df.join(o.df.select("block_id", F.col("v").alias(f"_v{n}")).hint("merge"), "block_id")
            parts.append(f"_v{n}")
        typed = lambda x: x.cast(kind) if kind else x.cast(DTYPES[self.dtype]).cast("double")
        both = F.transform(F.arrays_zip(*parts), lambda c: typed(f(*[c[p] for p in parts])))
        return replace(self, df=df.select("block_id", "origin", "extent", both.alias("v")))

    # tables by block

    def save(self, name: str, buckets: int) -> Tiles:
        """Keep it as a table in ``buckets`` by block, sorted: joins of such tables on the block need no exchange.

        As with cells, a large array gets more buckets.
        """
        return replace(self, df=save_buckets(self.df, name, self.cells, buckets, ["block_id"]))


def apply_steps(tiles: Tiles, steps: list[Step], shape_after: dict[int, int], complex_after: bool, scale: float = 1.0, tuning: stages.Tuning = stages.Tuning()) -> Tiles:
    """``stages.apply_steps`` on tiles: a stage is one exchange of pieces, or none where its axes are whole already."""
    ship(tiles.df.sparkSession)
    if max([tiles.shape[s[1]] for s in steps] + [shape_after.get(s[1], 0) for s in steps] + [0]) > tuning.line:
        out = stages.apply_steps(tiles.to_cells(), steps, shape_after, complex_after, scale, tuning)
        return Tiles.from_cells(out, cells=math.prod(tiles.tiling.chunk))
    room, at, batch, left = max(math.prod(tiles.tiling.chunk), 1), 0, len(tiles.extra), scale
    counts = stages.stage_axes([max(tiles.shape[s[1]], shape_after.get(s[1], 0)) for s in steps], tiles.cells, tuning)
    if not steps and scale != 1.0:
        return tiles._through(tiles.tiling, lambda x: x * scale, tiles.tiling, tiles.dtype)
    for count in counts:
        mine = steps[at : at + count]
        at += count
        whole = [batch + s[1] for s in mine]
        held = all(tiles.tiling.chunk[k] >= tiles.tiling.dims[k] for k in whole)
        before = tiles.tiling if held else tiling_for(tiles.tiling.dims, whole, room)
        dims, chunk = list(before.dims), list(before.chunk)
        for s in mine:
            if s[0] in ("rfft", "crfft"):
                dims[batch + s[1]] = chunk[batch + s[1]] = shape_after[s[1]]
        factor = left if at == len(steps) else 1.0

        def work(x: np.ndarray, mine=mine, factor=factor) -> np.ndarray:
            for s in mine:
                x = kernels.apply(s, x, batch + s[1])
            return x * factor if factor != 1.0 else x

        complex_ = stages._becomes_complex(tiles.complex, mine)
        wide = not tiles.single
        tiles = tiles._through(before, work, Tiling(tuple(dims), tuple(chunk)), ("c128" if wide else "c64") if complex_ else ("f64" if wide else "f32"))
        if (seen := stages.stages_seen.get()) is not None and not held:
            seen.append((tuple(s[1] for s in mine), tiles.df))
    if tiles.complex != complex_after:
        raise TransformError("the steps don't lead to the kind of result that was asked for")
    return tiles


def ends(tiles: Tiles, axis: int, n: int) -> NDArray:
    """Cells of the planes of a half spectrum that must be real, from the tiles that hold some."""
    k, planes = len(tiles.extra) + axis, [0, n // 2] if n % 2 == 0 else [0]
    there = [(F.col("origin")[k] <= p) & (p < F.col("origin")[k] + F.col("extent")[k]) for p in planes]
    some = tiles.with_df(tiles.df.filter(there[0] if len(there) == 1 else there[0] | there[1]))
    return stages.ends(some.to_cells(), axis, n)


def checked(tiles: Tiles, bad: DataFrame) -> Tiles:
    """The tiles, if ``bad`` (one row) counts no plane; the query that reads them fails otherwise."""
    verdict = F.when(bad.scalar() > 0, F.raise_error(F.lit("InvalidSpectrum: a plane of the half spectrum that must be real isn't")).cast("long"))
    return tiles.with_df(tiles.df.withColumn("block_id", F.coalesce(verdict, F.col("block_id"))))
