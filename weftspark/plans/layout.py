"""Layouts: how a dense array is cut into blocks and in which order a block's cells are stored.

A layout is metadata.  It decides block ids and physical order where they matter (redistribution, block files, ordered
folds); it never changes what an array holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AxisError, GeometryError, LayoutError, ShapeError, TopologyError


def partition_range(length: int, parts: int, coord: int) -> tuple[int, int]:
    """The half-open range that block ``coord`` of ``parts`` holds of an axis; it may be empty."""
    if parts < 1 or not 0 <= coord < parts or length < 0:
        raise GeometryError(f"no block {coord} of {parts} of a length of {length}")
    return length * coord // parts, length * (coord + 1) // parts


def range_of(length: Column, parts: Column, coord: Column) -> tuple[Column, Column]:
    """``partition_range`` as expressions."""
    at = lambda c: F.floor(length * c / parts).cast("long")
    return at(coord), at(coord + 1)


def block_of(index: Column, length: int | Column, parts: int | Column) -> Column:
    """The block that holds an index: the inverse of ``partition_range`` as an expression."""
    if isinstance(parts, int) and parts == 1:
        return F.lit(0).cast("long")
    return F.floor(((index + 1) * F.lit(parts) - 1) / F.lit(length)).cast("long")


def row_major_offset(shape: tuple[int, ...], index: tuple[int, ...]) -> int:
    """Linear position of an index; the last axis is the fastest."""
    if len(shape) != len(index):
        raise GeometryError("the index has another rank than the shape")
    out = 0
    for n, i in zip(shape, index, strict=True):
        if not 0 <= i < n:
            raise GeometryError(f"index {index} is outside {shape}")
        out = out * n + i
    return out


def offset_column(shape: tuple[int, ...], columns: list[Column]) -> Column:
    """The same for columns, by Horner's rule."""
    if len(shape) != len(columns):
        raise GeometryError("the index has another rank than the shape")
    return reduce(lambda acc, x: acc * F.lit(x[0]) + x[1], zip(shape, columns, strict=True), F.lit(0).cast("long"))


@dataclass(frozen=True)
class AxisPermutation:
    """Which logical axis stands at each memory position."""

    axes: tuple[int, ...]

    def __post_init__(self):
        if sorted(self.axes) != list(range(len(self.axes))):
            raise AxisError(f"{self.axes} is no permutation")

    @classmethod
    def identity(cls, rank: int) -> AxisPermutation:
        return cls(tuple(range(rank)))

    def permute(self, logical: tuple) -> tuple:
        """Logical order to memory order."""
        return tuple(logical[a] for a in self.axes)

    def unpermute(self, memory: tuple) -> tuple:
        """Memory order to logical order."""
        out = [None] * len(self.axes)
        for a, x in zip(self.axes, memory, strict=True):
            out[a] = x
        return tuple(out)

    def position_of(self, axis: int) -> int:
        return self.axes.index(axis)


@dataclass(frozen=True)
class BlockGrid:
    """A grid of logical blocks; blocks are not executors."""

    shape: tuple[int, ...]

    def __post_init__(self):
        if not self.shape or any(n < 1 for n in self.shape):
            raise TopologyError(f"{self.shape} is no grid of blocks")

    @classmethod
    def auto(cls, blocks: int, rank: int) -> BlockGrid:
        """The most even factorisation, larger factors first."""
        if blocks < 1 or rank < 1:
            raise TopologyError("a grid needs a block and an axis")

        def best(n: int, r: int) -> tuple[int, ...]:
            if r == 1:
                return (n,)
            options = (tuple(sorted((d, *best(n // d, r - 1)), reverse=True)) for d in range(1, n + 1) if n % d == 0)
            return min(options, key=lambda x: (x[0] - x[-1], x))

        return cls(best(blocks, rank))

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def rank_at(self, coords: tuple[int, ...]) -> int:
        try:
            return row_major_offset(self.shape, coords)
        except GeometryError as e:
            raise TopologyError(str(e)) from None

    def coords_of(self, rank: int) -> tuple[int, ...]:
        if not 0 <= rank < self.size:
            raise TopologyError(f"no block {rank}")
        out = []
        for n in reversed(self.shape):
            rank, c = divmod(rank, n)
            out.append(c)
        return tuple(reversed(out))

    @classmethod
    def from_cartesian(cls, dims: tuple[int, ...], periodic: tuple[bool, ...] | None = None) -> BlockGrid:
        """A grid with given extents; it has no ends that could meet, so ``periodic`` must name the same axes and is dropped."""
        if periodic is not None and len(periodic) != len(dims):
            raise TopologyError("a period, or none, is needed for each axis")
        return cls(tuple(dims))

    def line(self, rank: int, axis: int) -> list[int]:
        """The blocks that differ from one in a grid axis only, that one included, in order."""
        at = list(self.coords_of(rank))
        out = []
        for c in range(self.line_size(axis)):
            at[axis] = c
            out.append(self.rank_at(tuple(at)))
        return out

    def line_size(self, axis: int) -> int:
        """Blocks that differ in one grid axis only."""
        if not 0 <= axis < len(self.shape):
            raise TopologyError(f"no grid axis {axis}")
        return self.shape[axis]


@dataclass(frozen=True)
class Decomposition:
    """Which spatial axis each grid axis cuts."""

    rank: int
    axes: tuple[int, ...]

    def __post_init__(self):
        if not 1 <= len(self.axes) <= self.rank:
            raise AxisError("between one and all axes can be cut")
        if len(set(self.axes)) < len(self.axes) or any(not 0 <= a < self.rank for a in self.axes):
            raise AxisError(f"{self.axes} names an axis twice or one outside rank {self.rank}")

    def complete_grid(self, grid: BlockGrid) -> tuple[int, ...]:
        """Blocks along every spatial axis."""
        if len(grid.shape) != len(self.axes):
            raise TopologyError("the grid has another rank than the decomposition")
        out = [1] * self.rank
        for a, n in zip(self.axes, grid.shape, strict=True):
            out[a] = n
        return tuple(out)

    def complete_coords(self, coords: tuple[int, ...]) -> tuple[int, ...]:
        out = [0] * self.rank
        for a, c in zip(self.axes, coords, strict=True):
            out[a] = c
        return tuple(out)


@dataclass(frozen=True)
class Layout:
    """An immutable distribution and memory order of a global shape.  Layouts are equal by value."""

    shape: tuple[int, ...]
    grid: BlockGrid
    decomposition: Decomposition
    permutation: AxisPermutation

    def __post_init__(self):
        if any(n < 1 for n in self.shape):
            raise LayoutError(f"every extent of {self.shape} must be positive")
        if self.decomposition.rank != len(self.shape) or len(self.permutation.axes) != len(self.shape):
            raise LayoutError("decomposition, permutation and shape differ in rank")
        self.decomposition.complete_grid(self.grid)

    @classmethod
    def of(cls, shape, grid=(1,), axes=None, permutation=None) -> Layout:
        """By default the leading axes are cut and memory order is logical order."""
        shape, grid = tuple(shape), BlockGrid(tuple(grid))
        axes = tuple(range(len(grid.shape))) if axes is None else tuple(axes)
        permutation = AxisPermutation(tuple(permutation)) if permutation is not None else AxisPermutation.identity(len(shape))
        return cls(shape, grid, Decomposition(len(shape), axes), permutation)

    def with_decomposition(self, axes) -> Layout:
        return replace(self, decomposition=Decomposition(len(self.shape), tuple(axes)))

    def with_permutation(self, permutation) -> Layout:
        return replace(self, permutation=AxisPermutation(tuple(permutation)))

    def with_shape(self, shape) -> Layout:
        return replace(self, shape=tuple(shape))

    def reconfigured(self, shape, axes, permutation) -> Layout:
        return Layout(tuple(shape), self.grid, Decomposition(len(tuple(shape)), tuple(axes)), AxisPermutation(tuple(permutation)))

    @property
    def blocks_along(self) -> tuple[int, ...]:
        return self.decomposition.complete_grid(self.grid)

    def ranges_at(self, coords: tuple[int, ...]) -> list[tuple[int, int]]:
        full = self.decomposition.complete_coords(coords)
        return [partition_range(n, p, c) for n, p, c in zip(self.shape, self.blocks_along, full, strict=True)]

    def same_grid(self, other: Layout) -> bool:
        return self.grid == other.grid

    def same_distribution(self, other: Layout) -> bool:
        return self.same_grid(other) and self.shape == other.shape and self.decomposition == other.decomposition

    def same_layout(self, other: Layout) -> bool:
        return self == other

    def block(self, columns: list[Column]) -> Column:
        """The id of the block that holds a cell."""
        parts = [block_of(columns[a], self.shape[a], n) for a, n in zip(self.decomposition.axes, self.grid.shape, strict=True)]
        return offset_column(self.grid.shape, parts)

    def memory_order(self, columns: list) -> list:
        return list(self.permutation.permute(tuple(columns)))


def check_extra(extra: tuple[int, ...]) -> tuple[int, ...]:
    """Batch extents; zero is allowed, and no extents mean a single batch."""
    if any(n < 0 for n in extra):
        raise ShapeError(f"{extra} has a negative extent")
    return tuple(extra)
