"""Redistribution: transposes between layouts, and affine remaps.

A cell table has no place of its own, so a transpose changes which block owns a cell and how blocks are stored, never
a value.  It is materialised as one hash exchange on the new block id, or as no exchange where ownership stays.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RemapError, TransposeError
from ..plans.layout import Layout
from ..plans.measure import measured
from .array import MultiLayout, NDArray


@dataclass(frozen=True)
class LocalTranspose:
    """Another memory order under the same distribution: no exchange."""

    source: Layout
    target: Layout

    def __post_init__(self):
        if not self.source.same_distribution(self.target):
            raise TransposeError("a local transpose keeps the distribution")

    def apply(self, array: NDArray) -> NDArray:
        if array.layout != self.source:
            raise TransposeError("the array doesn't have the source layout")
        return array.with_df(array.df, layout=self.target)

    def ordered(self, array: NDArray) -> DataFrame:
        """Rows of each partition in the target's storage order."""
        out = self.apply(array)
        return out.table().sortWithinPartitions(*out.batch, *self.target.memory_order(out.space))

    def in_place(self, held: MultiLayout) -> MultiLayout:
        """Make the target the active layout of an array of several layouts."""
        held.overwrite_with(_known(held, self.target), self.apply)
        return held


def _known(held: MultiLayout, layout: Layout) -> int:
    if layout not in held.layouts:
        raise TransposeError("the array doesn't know the target layout")
    return held.layouts.index(layout)


@dataclass(frozen=True)
class Transpose:
    """Move cells to the owners of another decomposition that differs in exactly one grid axis.

    ``method`` names the transport of the two that array libraries offer; Spark's shuffle serves both.
    """

    source: Layout
    target: Layout
    method: str = "alltoallv"

    def __post_init__(self):
        if self.method not in ("alltoallv", "point_to_point"):
            raise TransposeError(f"no transport {self.method}")
        a, b = self.source, self.target
        if a.shape != b.shape or a.grid != b.grid:
            raise TransposeError("source and target differ in shape or grid")
        if sum(x != y for x, y in zip(a.decomposition.axes, b.decomposition.axes, strict=True)) != 1:
            raise TransposeError("exactly one grid axis must cut another spatial axis")

    @property
    def changed(self) -> int:
        """The grid axis that cuts another spatial axis."""
        pairs = zip(self.source.decomposition.axes, self.target.decomposition.axes, strict=True)
        return next(k for k, (x, y) in enumerate(pairs) if x != y)

    def apply(self, array: NDArray) -> NDArray:
        """The same cells under the target layout; nothing moves until a block-wise operation asks for it."""
        if array.layout != self.source:
            raise TransposeError("the array doesn't have the source layout")
        return array.with_df(array.df, layout=self.target)

    def materialise(self, array: NDArray) -> DataFrame:
        """Cells with their new ``block``, dealt by it: one exchange."""
        return self.apply(array).with_block().repartition(self.target.grid.size, "block")

    def in_place(self, held: MultiLayout) -> MultiLayout:
        """Make the target the active layout of an array of several layouts."""
        held.overwrite_with(_known(held, self.target), self.apply)
        return held

    def volume(self, array: NDArray) -> DataFrame:
        """How many cells go from which block to which: ``source``, ``target`` and ``cells``, the room that both need."""
        moved = array.df.select(array.block().alias("source"), self.apply(array).block().alias("target"))
        return moved.groupBy("source", "target").agg(F.count(F.lit(1)).alias("cells"))

    def with_timing(self, array: NDArray) -> tuple[DataFrame, dict[str, float]]:
        """``materialise``, and what Spark measured of one run of it: seconds up to the exchange's write (``pack``), of
        reading from it (``exchange``) and of the whole (``total``), and the ``rows`` and ``bytes`` that it moved."""
        out = self.materialise(array)
        began = time.perf_counter()
        uses = measured(out)
        total = time.perf_counter() - began
        written, read = [u for u in uses if u.rows_written], uses[-1:]
        return out, {"pack": sum(u.seconds for u in written), "exchange": sum(u.seconds for u in read), "total": total, "rows": sum(u.rows_read for u in read), "bytes": sum(u.bytes_read for u in read)}

    def with_callback(self, array: NDArray, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``f`` becomes the next narrow step over the moved cells."""
        return f(self.materialise(array))


@dataclass(frozen=True)
class Remap:
    """source[a] = (sign[a] * target[a] + offset[a]) mod extent, for every spatial axis.

    Since sign * sign = 1 the target of a cell is a projection of its coordinates: no join, and no exchange until the
    target's blocks are asked for.
    """

    source: Layout
    target: Layout
    signs: tuple[int, ...]
    offsets: tuple[int, ...]

    def __post_init__(self):
        rank = len(self.source.shape)
        if self.source.shape != self.target.shape:
            raise RemapError("source and target differ in shape")
        if len(self.signs) != rank or len(self.offsets) != rank or any(s not in (-1, 1) for s in self.signs):
            raise RemapError("a sign of 1 or -1 and an offset are needed for each axis")

    def apply(self, array: NDArray) -> NDArray:
        if array.layout != self.source:
            raise RemapError("the array doesn't have the source layout")
        out = []
        for c, n, sign, offset in zip(array.space, self.source.shape, self.signs, self.offsets, strict=True):
            out.append(F.pmod(F.lit(sign) * (F.col(c) - F.lit(offset % n)), F.lit(n)).cast("long").alias(c))
        return array.with_df(array.df.select(*array.batch, *out, *array.values), layout=self.target)


def remap(array: NDArray, signs: Sequence[int], offsets: Sequence[int], target: Layout | None = None) -> NDArray:
    return Remap(array.layout, target or array.layout, tuple(signs), tuple(offsets)).apply(array)
