"""Transform plans over dense arrays.

A plan is built once for a shape and is a function from arrays, of cells or of tiles, to lazy arrays of the same form.  ``forward`` and ``backward`` are raw,
``inverse`` is ``backward`` divided by the product of the factors of the transformed axes.  Axes that aren't selected
pass through untouched and cost no exchange.  Batch axes are independent, and a collection is one more batch axis.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, fields, replace
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .._ship import ship
from ..errors import AxisError, CollectionError, FftError, InvalidSpectrum, LocalC2cError, LocalC2cNdError, LocalR2cError, LocalR2rError, MixedError, OverlapError, R2cError, R2rError, TransformError, WrongState
from ..functions import kernels
from ..functions.kernels import Step
from ..operators import tiles
from ..operators.array import NDArray
from ..operators.tiles import Tiles
from .layout import Layout
from .measure import StageUse, measured
from .stages import Tuning, apply_steps, check_boundary, ends, rejected, stage_axes, stages_seen

FORWARD, BACKWARD = -1, 1

#: Rounding allowed at the real planes of a half spectrum, in units of epsilon and the least subnormal.
_ALLOWED, _EPS, _TINY = 128, {"f64": 2.0**-52, "f32": 2.0**-23}, {"f64": 5e-324, "f32": 1.401298464324817e-45}


@dataclass(frozen=True)
class AxisSelection:
    """The axes that a plan transforms; the order in which they are named doesn't matter."""

    rank: int
    axes: tuple[int, ...]

    @classmethod
    def all(cls, rank: int) -> AxisSelection:
        return cls(rank, tuple(range(rank)))

    @classmethod
    def empty(cls, rank: int) -> AxisSelection:
        return cls(rank, ())

    @classmethod
    def from_indices(cls, rank: int, axes: Iterable[int]) -> AxisSelection:
        axes = list(axes)
        if len(set(axes)) < len(axes) or any(not 0 <= a < rank for a in axes):
            raise AxisError(f"{axes} names an axis twice or one outside rank {rank}")
        return cls(rank, tuple(sorted(axes)))

    def __contains__(self, axis: int) -> bool:
        return axis in self.axes

    def __len__(self) -> int:
        return len(self.axes)

    def is_all(self) -> bool:
        return len(self.axes) == self.rank

    def is_empty(self) -> bool:
        return not self.axes


def _select(rank: int, axes) -> AxisSelection:
    if axes is None:
        return AxisSelection.all(rank)
    return axes if isinstance(axes, AxisSelection) else AxisSelection.from_indices(rank, axes)


@dataclass(frozen=True)
class Options:
    """Transport and output order, which are recorded in the output layout, and the sizes at which stages are cut; none
    of them changes a value."""

    transpose_method: str = "alltoallv"
    permute_dims: bool = True
    tuning: Tuning = Tuning()

    def __post_init__(self):
        if self.transpose_method not in ("alltoallv", "point_to_point"):
            raise TransformError(f"no transport {self.transpose_method}")


@dataclass(frozen=True)
class Plan:
    """What all plans share."""

    error: ClassVar[type[TransformError]] = TransformError

    shape: tuple[int, ...]
    extra: tuple[int, ...] = ()
    options: Options = field(default_factory=Options)

    def __post_init__(self):
        if not self.shape or any(n < 1 for n in self.shape):
            raise self.error(f"{self.shape} is no shape to transform")
        if any(n < 0 for n in self.extra):
            raise self.error(f"{self.extra} is no batch shape")

    @classmethod
    def like(cls, array: NDArray, *what, **kwargs):
        """A plan for arrays like this one; ``what`` is the plan's own first field (axes, kinds or transforms)."""
        own = dict(zip((f.name for f in fields(cls)[3:]), what, strict=False))
        return cls(array.shape, extra=array.extra, **own, **kwargs)

    @property
    def input_shape(self) -> tuple[int, ...]:
        return self.shape

    @property
    def output_shape(self) -> tuple[int, ...]:
        return self.shape

    def backend_kind(self) -> str:
        return "numpy"

    def backend_options(self) -> dict[str, str]:
        """The kernels have no options."""
        return {}

    def _apply(self, array: NDArray | Tiles, steps: list[Step], shape_after: dict[int, int], complex_after: bool, scale: float = 1.0) -> NDArray | Tiles:
        run = tiles.apply_steps if isinstance(array, Tiles) else apply_steps
        return run(array, steps, shape_after, complex_after, scale, self.options.tuning)

    def _real_planes(self, array: NDArray, steps: list[Step], axis: int, n: int, limits: tuple[float, float]) -> NDArray:
        """A half spectrum after ``steps`` along other axes than the real one, checked at the planes that must be real."""
        if isinstance(array, Tiles):
            return tiles.checked(self._apply(array, steps, {}, True), self._bad_planes(array, steps, axis, n, limits))
        return check_boundary(self._apply(array, steps, {}, True), self._aside(ends(array, axis, n), steps), axis, n, *limits)

    def _bad_planes(self, array: NDArray | Tiles, steps: list[Step], axis: int, n: int, limits: tuple[float, float]) -> DataFrame:
        planes = tiles.ends(array, axis, n) if isinstance(array, Tiles) else ends(array, axis, n)
        return rejected(self._aside(planes, steps), axis, n, *limits)

    def _aside(self, planes: NDArray, steps: list[Step]) -> NDArray:
        """Steps that are no stages of the transform."""
        mark = stages_seen.set(None)
        try:
            return self._apply(planes, steps, {}, True)
        finally:
            stages_seen.reset(mark)

    def _spectrum(self, array: NDArray, operation: str) -> tuple[list[Step], int, int, tuple[float, float]]:
        """Of an operation that takes a half spectrum: steps before the check, real axis, real length, and limits."""
        raise self.error("the plan takes no half spectrum")

    def check_spectrum(self, array: NDArray, operation: str = "inverse") -> NDArray:
        """The array, if ``operation`` takes it (runs a job over the planes that must be real)."""
        steps, axis, n, limits = self._spectrum(array, operation)
        bad = self._bad_planes(array, steps, axis, n, limits).first()[0]
        if bad:
            raise InvalidSpectrum(f"{bad} planes of the half spectrum that must be real aren't")
        return array

    def _check(self, array: NDArray, shape: tuple[int, ...], complex_: bool | None) -> None:
        if array.shape != shape or array.extra != self.extra:
            raise self.error(f"the plan is for {self.extra} x {shape}, the array is {array.extra} x {array.shape}")
        if array.dtype not in ("f32", "f64", "c64", "c128") or complex_ is not None and array.complex != complex_:
            raise self.error(f"the plan doesn't take {array.dtype}")

    def _named(self, out: NDArray, forward: bool) -> NDArray:
        """The output's declared memory order: reversed axes after a forward transform, unless that is switched off."""
        if forward and self.options.permute_dims:
            return out.with_df(out.df, layout=out.layout.with_permutation(tuple(reversed(range(out.rank)))))
        return out.with_df(out.df, layout=out.layout.with_permutation(tuple(range(out.rank))))

    def forward(self, array: NDArray) -> NDArray:
        raise NotImplementedError

    def backward(self, array: NDArray) -> NDArray:
        raise NotImplementedError

    def inverse(self, array: NDArray) -> NDArray:
        raise NotImplementedError

    # collections

    def _members(self, arrays: Sequence[NDArray]) -> None:
        """All members are checked before anything is built."""
        if not arrays:
            raise CollectionError("a collection needs a member")
        for m, a in enumerate(arrays):
            if a.shape != arrays[0].shape or a.extra != self.extra or a.dtype != arrays[0].dtype:
                raise CollectionError(f"member {m} isn't like the first", m)

    def _many(self, arrays: Sequence[NDArray], operation: str) -> list[NDArray]:
        """Each member's result is a table of its own: reading one computes that one, reading all computes each once."""
        self._members(arrays)
        return [getattr(self, operation)(a) for a in arrays]

    def stacked(self, arrays: Sequence[NDArray], operation: str = "forward") -> NDArray:
        """All members' results in one job, under a leading member axis."""
        self._members(arrays)
        return getattr(self.batched(len(arrays)), operation)(stack(arrays))

    def batched(self, members: int):
        """The same plan with one more leading batch axis."""
        return replace(self, extra=(members, *self.extra))

    def forward_many(self, arrays: Sequence[NDArray]) -> list[NDArray]:
        return self._many(arrays, "forward")

    def backward_many(self, arrays: Sequence[NDArray]) -> list[NDArray]:
        return self._many(arrays, "backward")

    def inverse_many(self, arrays: Sequence[NDArray]) -> list[NDArray]:
        return self._many(arrays, "inverse")

    def in_place(self, array: NDArray) -> InPlace:
        return InPlace(self, array)

    def in_place_many(self, arrays: Sequence[NDArray]) -> list[InPlace]:
        self._members(arrays)
        return [InPlace(self, a) for a in arrays]

    def allocate_in_place(self, spark: SparkSession, dtype: str) -> InPlace:
        return InPlace(self, self.allocate_input(spark, dtype))

    # what a plan says of itself

    def _steps(self) -> list[int]:
        """The axes that a forward transform works on, in order."""
        raise NotImplementedError

    @property
    def stage_geometry(self) -> list[tuple[int, ...]]:
        """The axes of each stage of a forward transform; a stage is one exchange."""
        axes = self._steps()
        cells = math.prod(self.shape) * math.prod(self.extra)
        out, at = [], 0
        for n in stage_axes([max(self.input_shape[k], self.output_shape[k]) for k in axes], cells, self.options.tuning) if axes else []:
            out.append(tuple(axes[at : at + n]))
            at += n
        return out

    def allocate_input(self, spark: SparkSession, dtype: str) -> NDArray:
        """Zeros that the plan takes."""
        return _zeros(spark, self.input_shape, self.extra, dtype)

    def allocate_output(self, spark: SparkSession, dtype: str) -> NDArray:
        """Zeros of the shape that a forward transform gives."""
        return _zeros(spark, self.output_shape, self.extra, dtype)

    def with_timing(self, array: NDArray, operation: str = "forward") -> tuple[NDArray, Timing]:
        """The result, and what one run of it took: Spark's own figures of each stage, the stages of the transform named by
        their axes.  What comes before these (reading the array, the check of a half spectrum) is under no axes."""
        seen: list = []
        mark = stages_seen.set(seen)
        try:
            out = getattr(self, operation)(array)
        finally:
            stages_seen.reset(mark)
        began = time.perf_counter()
        uses = measured(out.df)
        total = time.perf_counter() - began
        axes = [a for a, _ in seen][-len(uses) :] if uses else []
        named = [*[()] * (len(uses) - len(axes)), *axes]
        return out, Timing(tuple((a, u.seconds) for a, u in zip(named, uses, strict=True) if a), total, tuple(zip(named, uses, strict=True)))

    def with_overlap(self, array: NDArray, operation: str = "forward") -> NDArray:
        """The same numbers; exchange and work overlap in Spark anyway, but only point-to-point plans may ask for it."""
        if self.options.transpose_method != "point_to_point":
            raise OverlapError("overlap needs the point-to-point transport")
        return getattr(self, operation)(array)


@dataclass(frozen=True)
class Timing:
    """Wall seconds of each stage of a transform (its axes) and of the whole run; ``uses`` has all stages that ran, with
    their rows and bytes."""

    stages: tuple[tuple[tuple[int, ...], float], ...]
    total: float
    uses: tuple[tuple[tuple[int, ...], StageUse], ...] = ()


def stack(arrays: Sequence[NDArray]) -> NDArray:
    """Members as a leading batch axis: one table, one job for all."""
    first = arrays[0]
    renamed = {f"x{k}": f"x{k + 1}" for k in range(len(first.extra))}
    parts = [a.table().withColumnsRenamed(renamed).withColumn("x0", F.lit(m).cast("long")) for m, a in enumerate(arrays)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return first.with_df(df, extra=(len(arrays), *first.extra))


def unstack(array: NDArray) -> list[NDArray]:
    renamed = {f"x{k + 1}": f"x{k}" for k in range(len(array.extra) - 1)}
    return [array.with_df(array.df.filter(F.col("x0") == m).drop("x0").withColumnsRenamed(renamed), extra=array.extra[1:]) for m in range(array.extra[0])]


@dataclass
class InPlace:
    """An array that a plan rewrites; ``state`` says what it holds."""

    plan: Plan
    array: NDArray
    state: str = "input"

    def view(self, state: str) -> NDArray:
        """What it holds, if that is the ``input`` or ``output`` asked for."""
        if self.state != state:
            raise WrongState(f"there is no view of the {state} in state {self.state}")
        return self.array

    def _to(self, operation: str, need: str, after: str) -> InPlace:
        if self.state != need:
            raise WrongState(f"{operation} needs an array in state {need}, this one is in state {self.state}")
        self.state = "poisoned"
        self.array = getattr(self.plan, operation)(self.array)
        self.state = after
        return self

    def forward(self) -> InPlace:
        return self._to("forward", "input", "output")

    def inverse(self) -> InPlace:
        return self._to("inverse", "output", "input")

    def backward(self) -> InPlace:
        return self._to("backward", "output", "input")


def _order(axes: Iterable[int], forward: bool) -> list[int]:
    """Forward plans go from the last axis to the first, reverse ones back."""
    return sorted(axes, reverse=forward)


@dataclass(frozen=True)
class C2c(Plan):
    """Complex to complex along the selected axes; ``directions`` gives each axis the sign of its forward exponent."""

    error: ClassVar[type[TransformError]] = FftError

    axes: AxisSelection | Sequence[int] | None = None
    directions: tuple[int, ...] | None = None

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "axes", _select(len(self.shape), self.axes))
        signs = self.directions or (FORWARD,) * len(self.shape)
        if len(signs) != len(self.shape) or any(s not in (FORWARD, BACKWARD) for s in signs):
            raise self.error("a direction is needed for each axis")
        if any(s != FORWARD for k, s in enumerate(signs) if k not in self.axes):
            raise self.error("an axis that isn't transformed has no direction")
        object.__setattr__(self, "directions", tuple(signs))

    def _steps(self) -> list[int]:
        return _order(self.axes.axes, True)

    @property
    def factor(self) -> int:
        return math.prod(self.shape[k] for k in self.axes.axes)

    def _run(self, array: NDArray, way: int, scale: float) -> NDArray:
        self._check(array, self.shape, True)
        steps: list[Step] = [("fft", k, self.directions[k] * -way) for k in _order(self.axes.axes, way < 0)]
        return self._named(self._apply(array, steps, {}, True, scale), way < 0)

    def forward(self, array: NDArray) -> NDArray:
        return self._run(array, FORWARD, 1.0)

    def backward(self, array: NDArray) -> NDArray:
        return self._run(array, BACKWARD, 1.0)

    def inverse(self, array: NDArray) -> NDArray:
        return self._run(array, BACKWARD, 1.0 / self.factor)


def _levels(n: int) -> int:
    return math.ceil(math.log2(n)) if n > 1 else 0


def _limits(dtype: str, depth: int, grown: float) -> tuple[float, float]:
    kind = "f64" if dtype in ("f64", "c128") else "f32"
    return _ALLOWED * _EPS[kind] * depth, _ALLOWED * _TINY[kind] * depth * grown


@dataclass(frozen=True)
class R2c(Plan):
    """Real to half spectrum: the largest selected axis keeps n // 2 + 1 entries, the others are complex transforms."""

    error: ClassVar[type[TransformError]] = R2cError

    axes: AxisSelection | Sequence[int] | None = None

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "axes", _select(len(self.shape), self.axes))
        if self.axes.is_empty():
            raise self.error("a real axis is needed")

    @property
    def real_axis(self) -> int:
        return max(self.axes.axes)

    @property
    def real_len(self) -> int:
        return self.shape[self.real_axis]

    @property
    def output_shape(self) -> tuple[int, ...]:
        return _half(self.shape, self.real_axis)

    def _steps(self) -> list[int]:
        return [self.real_axis, *(k for k in _order(self.axes.axes, True) if k != self.real_axis)]

    @property
    def factor(self) -> int:
        return math.prod(self.shape[k] for k in self.axes.axes)

    def forward(self, array: NDArray) -> NDArray:
        self._check(array, self.shape, False)
        r = self.real_axis
        steps: list[Step] = [("rfft", r, -1), *(("fft", k, -1) for k in _order(self.axes.axes, True) if k != r)]
        return self._named(self._apply(array, steps, {r: self.output_shape[r]}, True), True)

    def _spectrum(self, array: NDArray, operation: str):
        self._check(array, self.output_shape, True)
        others = [k for k in _order(self.axes.axes, False) if k != self.real_axis]
        grown = math.prod(self.shape[k] for k in others) if operation == "backward" else 1
        limits = _limits(array.dtype, 1 + sum(_levels(self.shape[k]) for k in others), grown)
        return [("fft", k, 1) for k in others], self.real_axis, self.real_len, limits

    def _reverse(self, array: NDArray, scale: float, operation: str) -> NDArray:
        mid = self._real_planes(array, *self._spectrum(array, operation))
        r = self.real_axis
        return self._named(self._apply(mid, [("crfft", r, self.real_len)], {r: self.real_len}, False, scale), False)

    def backward(self, array: NDArray) -> NDArray:
        return self._reverse(array, 1.0, "backward")

    def inverse(self, array: NDArray) -> NDArray:
        return self._reverse(array, 1.0 / self.factor, "inverse")


def _half(shape: tuple[int, ...], axis: int) -> tuple[int, ...]:
    return tuple(n // 2 + 1 if k == axis else n for k, n in enumerate(shape))


@dataclass(frozen=True)
class C2r(Plan):
    """Half spectrum to real by the positive exponent: the lowest selected axis is the real one, of ``shape``'s extent.

    ``shape`` is that of the real output, since the half spectrum doesn't tell even from odd.
    """

    error: ClassVar[type[TransformError]] = R2cError

    axes: AxisSelection | Sequence[int] | None = None

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "axes", _select(len(self.shape), self.axes))
        if self.axes.is_empty():
            raise self.error("a real axis is needed")

    @property
    def real_axis(self) -> int:
        return min(self.axes.axes)

    @property
    def real_len(self) -> int:
        return self.shape[self.real_axis]

    @property
    def input_shape(self) -> tuple[int, ...]:
        return _half(self.shape, self.real_axis)

    def _steps(self) -> list[int]:
        return [*(k for k in _order(self.axes.axes, True) if k != self.real_axis), self.real_axis]

    @property
    def factor(self) -> int:
        return math.prod(self.shape[k] for k in self.axes.axes)

    def _spectrum(self, array: NDArray, operation: str):
        self._check(array, self.input_shape, True)
        others = [k for k in _order(self.axes.axes, True) if k != self.real_axis]
        limits = _limits(array.dtype, 1 + sum(_levels(self.shape[k]) for k in others), math.prod(self.shape[k] for k in others))
        return [("fft", k, 1) for k in others], self.real_axis, self.real_len, limits

    def check_spectrum(self, array: NDArray, operation: str = "forward") -> NDArray:
        return super().check_spectrum(array, operation)

    def forward(self, array: NDArray) -> NDArray:
        mid = self._real_planes(array, *self._spectrum(array, "forward"))
        r = self.real_axis
        return self._named(self._apply(mid, [("crfft", r, self.real_len)], {r: self.real_len}, False), True)

    def _reverse(self, array: NDArray, scale: float) -> NDArray:
        self._check(array, self.shape, False)
        r = self.real_axis
        steps: list[Step] = [("rfft", r, -1), *(("fft", k, -1) for k in _order(self.axes.axes, False) if k != r)]
        return self._named(self._apply(array, steps, {r: self.input_shape[r]}, True, scale), False)

    def backward(self, array: NDArray) -> NDArray:
        return self._reverse(array, 1.0)

    def inverse(self, array: NDArray) -> NDArray:
        return self._reverse(array, 1.0 / self.factor)


@dataclass(frozen=True)
class R2r(Plan):
    """A real-to-real kind (or None) for each axis, on real or complex arrays."""

    error: ClassVar[type[TransformError]] = R2rError

    kinds: tuple[str | None, ...] = ()

    def __post_init__(self):
        super().__post_init__()
        if len(self.kinds) != len(self.shape):
            raise self.error("a kind, or None, is needed for each axis")
        for kind, n in zip(self.kinds, self.shape, strict=True):
            if kind is not None:
                if kind not in kernels.R2R_KINDS:
                    raise self.error(f"no real-to-real kind {kind}")
                kernels.check_length(kind, n)

    def _steps(self) -> list[int]:
        return _order((k for k, x in enumerate(self.kinds) if x), True)

    @property
    def factor(self) -> int:
        return math.prod(kernels.factor(k, n) for k, n in zip(self.kinds, self.shape, strict=True) if k)

    def _run(self, array: NDArray, forward: bool, scale: float) -> NDArray:
        self._check(array, self.shape, None)
        steps: list[Step] = [(self.kinds[k] if forward else kernels.REVERSE[self.kinds[k]], k, 0) for k in _order((k for k, x in enumerate(self.kinds) if x), forward)]
        return self._named(self._apply(array, steps, {}, array.complex, scale), forward)

    def forward(self, array: NDArray) -> NDArray:
        return self._run(array, True, 1.0)

    def backward(self, array: NDArray) -> NDArray:
        return self._run(array, False, 1.0)

    def inverse(self, array: NDArray) -> NDArray:
        return self._run(array, False, 1.0 / self.factor)


@dataclass(frozen=True)
class Dht(Plan):
    """Separable Hartley transform of the selected axes; its own reverse."""

    error: ClassVar[type[TransformError]] = R2rError

    axes: AxisSelection | Sequence[int] | None = None

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "axes", _select(len(self.shape), self.axes))

    def _steps(self) -> list[int]:
        return _order(self.axes.axes, True)

    @property
    def factor(self) -> int:
        return math.prod(self.shape[k] for k in self.axes.axes)

    def _run(self, array: NDArray, forward: bool, scale: float) -> NDArray:
        self._check(array, self.shape, None)
        return self._named(self._apply(array, [("dht", k, 0) for k in _order(self.axes.axes, forward)], {}, array.complex, scale), forward)

    def forward(self, array: NDArray) -> NDArray:
        return self._run(array, True, 1.0)

    def backward(self, array: NDArray) -> NDArray:
        return self._run(array, False, 1.0)

    def inverse(self, array: NDArray) -> NDArray:
        return self._run(array, False, 1.0 / self.factor)


def _signs(transforms: tuple[str | None, ...], directions: tuple[int, ...] | None) -> tuple[int, ...]:
    signs = directions or (FORWARD,) * len(transforms)
    if len(signs) != len(transforms) or any(s not in (FORWARD, BACKWARD) for s in signs):
        raise TransformError("a direction is needed for each axis")
    if any(s != FORWARD for s, t in zip(signs, transforms, strict=True) if t != "fft"):
        raise TransformError("only an fft axis has a direction")
    return tuple(signs)


def _reverse_step(kind: str, axis: int, sign: int) -> Step:
    return ("fft", axis, -sign) if kind == "fft" else (kernels.REVERSE[kind], axis, 0)


@dataclass(frozen=True)
class MixedC2c(Plan):
    """Each axis None, ``fft``, ``dht`` or a real-to-real kind, on complex arrays."""

    error: ClassVar[type[TransformError]] = MixedError

    transforms: tuple[str | None, ...] = ()
    directions: tuple[int, ...] | None = None

    def __post_init__(self):
        super().__post_init__()
        if len(self.transforms) != len(self.shape):
            raise self.error("a transform, or None, is needed for each axis")
        for kind, n in zip(self.transforms, self.shape, strict=True):
            if kind is not None:
                if kind not in ("fft", "dht", *kernels.R2R_KINDS):
                    raise self.error(f"a complex plan has no {kind} axis")
                kernels.check_length(kind, n)
        object.__setattr__(self, "directions", _signs(self.transforms, self.directions))

    def _steps(self) -> list[int]:
        return self._axes(True)

    @property
    def factor(self) -> int:
        return math.prod(kernels.factor(k, n) for k, n in zip(self.transforms, self.shape, strict=True) if k)

    def _axes(self, forward: bool) -> list[int]:
        return _order((k for k, t in enumerate(self.transforms) if t), forward)

    def forward(self, array: NDArray) -> NDArray:
        self._check(array, self.shape, True)
        return self._named(self._apply(array, [(self.transforms[k], k, self.directions[k]) for k in self._axes(True)], {}, True), True)

    def _reverse(self, array: NDArray, scale: float) -> NDArray:
        self._check(array, self.shape, True)
        steps = [_reverse_step(self.transforms[k], k, self.directions[k]) for k in self._axes(False)]
        return self._named(self._apply(array, steps, {}, True, scale), False)

    def backward(self, array: NDArray) -> NDArray:
        return self._reverse(array, 1.0)

    def inverse(self, array: NDArray) -> NDArray:
        return self._reverse(array, 1.0 / self.factor)


@dataclass(frozen=True)
class MixedR2c(Plan):
    """One ``rfft`` axis; axes after it are real (None, ``dht``, real-to-real), axes before it may be ``fft`` as well."""

    error: ClassVar[type[TransformError]] = MixedError

    transforms: tuple[str | None, ...] = ()
    directions: tuple[int, ...] | None = None

    def __post_init__(self):
        super().__post_init__()
        if len(self.transforms) != len(self.shape) or self.transforms.count("rfft") != 1:
            raise self.error("one transform for each axis is needed, of which one is rfft")
        for k, (kind, n) in enumerate(zip(self.transforms, self.shape, strict=True)):
            allowed = ("dht", *kernels.R2R_KINDS) + (("fft",) if k < self.real_axis else ("rfft",) if k == self.real_axis else ())
            if kind is not None:
                if kind not in allowed:
                    raise self.error(f"axis {k} can't be {kind}")
                kernels.check_length(kind, n)
        object.__setattr__(self, "directions", _signs(self.transforms, self.directions))

    @property
    def real_axis(self) -> int:
        return self.transforms.index("rfft")

    @property
    def original_n(self) -> int:
        return self.shape[self.real_axis]

    @property
    def output_shape(self) -> tuple[int, ...]:
        return _half(self.shape, self.real_axis)

    def _steps(self) -> list[int]:
        return _order((k for k, t in enumerate(self.transforms) if t), True)

    @property
    def factor(self) -> int:
        return math.prod(kernels.factor(k, n) for k, n in zip(self.transforms, self.shape, strict=True) if k)

    def _parts(self) -> tuple[list[int], list[int]]:
        used = [k for k, t in enumerate(self.transforms) if t]
        return [k for k in used if k > self.real_axis], [k for k in used if k < self.real_axis]

    def forward(self, array: NDArray) -> NDArray:
        self._check(array, self.shape, False)
        real, complex_ = self._parts()
        r = self.real_axis
        steps: list[Step] = [(self.transforms[k], k, 0) for k in _order(real, True)] + [("rfft", r, -1)]
        steps += [(self.transforms[k], k, self.directions[k]) for k in _order(complex_, True)]
        return self._named(self._apply(array, steps, {r: self.output_shape[r]}, True), True)

    def _spectrum(self, array: NDArray, operation: str):
        self._check(array, self.output_shape, True)
        _, complex_ = self._parts()
        depth = 1 + sum(_levels(kernels.embedding_length(self.transforms[k], self.shape[k])) + (0 if self.transforms[k] == "fft" else 2) for k in complex_)
        grown = math.prod(kernels.factor(self.transforms[k], self.shape[k]) for k in complex_) if operation == "backward" else 1
        steps = [_reverse_step(self.transforms[k], k, self.directions[k]) for k in _order(complex_, False)]
        return steps, self.real_axis, self.original_n, _limits(array.dtype, depth, grown)

    def _reverse(self, array: NDArray, scale: float, operation: str) -> NDArray:
        mid = self._real_planes(array, *self._spectrum(array, operation))
        real, r = self._parts()[0], self.real_axis
        steps: list[Step] = [("crfft", r, self.original_n)] + [(kernels.REVERSE[self.transforms[k]], k, 0) for k in _order(real, False)]
        return self._named(self._apply(mid, steps, {r: self.original_n}, False, scale), False)

    def backward(self, array: NDArray) -> NDArray:
        return self._reverse(array, 1.0, "backward")

    def inverse(self, array: NDArray) -> NDArray:
        return self._reverse(array, 1.0 / self.factor, "inverse")


# transforms of flat lines in memory; ``transform_lines`` applies them to the rows of a DataFrame


def _lines(x, n: int, error: type[TransformError]) -> np.ndarray:
    x = np.asarray(x)
    if x.ndim != 1 or x.size % n:
        raise error(f"{x.size} values are no whole number of lines of {n}")
    return x.reshape(-1, n)


class LocalPlan:
    """What local plans share."""

    def backend_kind(self) -> str:
        return "numpy"

    def backend_options(self) -> dict[str, str]:
        """The kernels have no options."""
        return {}


@dataclass(frozen=True)
class LocalC2c(LocalPlan):
    """Batched complex lines of ``line_len``."""

    line_len: int

    def __post_init__(self):
        kernels.check_length("fft", self.line_len)

    def forward(self, x):
        return kernels.fft(_lines(x, self.line_len, LocalC2cError), 1, -1).ravel()

    def backward(self, x):
        return kernels.fft(_lines(x, self.line_len, LocalC2cError), 1, 1).ravel()

    def inverse(self, x):
        return self.backward(x) / self.line_len


@dataclass(frozen=True)
class LocalC2cNd(LocalPlan):
    """A batch of column-major blocks (axis 0 is the fastest), transformed along ``axes`` in the order given."""

    shape: tuple[int, ...]
    axes: tuple[int, ...]

    def __post_init__(self):
        if not self.shape or any(n < 1 for n in self.shape):
            raise LocalC2cNdError(f"{self.shape} is no shape to transform")
        AxisSelection.from_indices(len(self.shape), self.axes)

    def _run(self, x, sign: int, scale: float):
        x = np.asarray(x)
        if x.size % math.prod(self.shape):
            raise LocalC2cNdError(f"{x.size} values for blocks of {self.shape}")
        out = x.reshape(-1, *reversed(self.shape)).astype(np.complex128)
        for a in self.axes:
            out = kernels.fft(out, len(self.shape) - a, sign)
        return (out * scale).ravel()

    def forward(self, x):
        return self._run(x, -1, 1.0)

    def backward(self, x):
        return self._run(x, 1, 1.0)

    def inverse(self, x):
        return self._run(x, 1, 1.0 / math.prod(self.shape[a] for a in self.axes))


@dataclass(frozen=True)
class LocalR2c(LocalPlan):
    """Batched real lines of ``real_len``; the reverse wants exactly real DC and Nyquist entries."""

    real_len: int

    def __post_init__(self):
        kernels.check_length("rfft", self.real_len)

    @property
    def complex_len(self) -> int:
        return self.real_len // 2 + 1

    def forward(self, x):
        return kernels.rfft(_lines(x, self.real_len, LocalR2cError), 1, -1).ravel()

    def backward(self, x):
        x = _lines(x, self.complex_len, LocalR2cError)
        for k in {0, self.real_len // 2} if self.real_len % 2 == 0 else {0}:
            if len(bad := np.flatnonzero(~(x[:, k].imag == 0))):
                raise LocalR2cError(f"line {bad[0]}: entry {k} must be real")
        return kernels.crfft(x, 1, self.real_len, 1).ravel()

    def inverse(self, x):
        return self.backward(x) / self.real_len


class PackedR2c:
    """Lines of a ``LocalR2c`` plan that are real or half spectra in the same memory, whichever they were made last.

    Each line has room for its half spectrum; its real values are the first ``real_len`` numbers of that room.
    """

    def __init__(self, plan: LocalR2c, lines: int):
        self.plan, self.state = plan, "real"
        self._room = np.zeros((lines, plan.complex_len), np.complex128)

    @property
    def real_view(self) -> np.ndarray:
        self._needs("real")
        return self._room.view(np.float64)[:, : self.plan.real_len]

    @property
    def complex_view(self) -> np.ndarray:
        self._needs("complex")
        return self._room

    def _needs(self, state: str) -> None:
        if self.state != state:
            raise WrongState(f"the lines are {self.state}, not {state}")

    def forward_in_place(self) -> PackedR2c:
        values = self.real_view.ravel().copy()
        self.state = "poisoned"
        self._room[:] = self.plan.forward(values).reshape(self._room.shape)
        self.state = "complex"
        return self

    def inverse_in_place(self) -> PackedR2c:
        values = self.complex_view.ravel().copy()
        self.state = "poisoned"
        real = self.plan.inverse(values)
        self._room.view(np.float64)[:, : self.plan.real_len] = real.reshape(len(self._room), -1)
        self.state = "real"
        return self


@dataclass(frozen=True)
class LocalR2r(LocalPlan):
    """Batched lines under one real-to-real kind."""

    line_len: int
    kind: str

    def __post_init__(self):
        if self.kind not in kernels.R2R_KINDS:
            raise LocalR2rError(f"no real-to-real kind {self.kind}")
        kernels.check_length(self.kind, self.line_len)

    def forward(self, x):
        return kernels.r2r(self.kind, _lines(x, self.line_len, LocalR2rError), 1).ravel()

    def backward(self, x):
        return kernels.r2r(kernels.REVERSE[self.kind], _lines(x, self.line_len, LocalR2rError), 1).ravel()

    def inverse(self, x):
        return self.backward(x) / kernels.factor(self.kind, self.line_len)


@dataclass(frozen=True)
class LocalDht(LocalPlan):
    """Batched lines under the Hartley transform."""

    line_len: int

    def __post_init__(self):
        kernels.check_length("dht", self.line_len)

    def forward(self, x):
        return kernels.dht(_lines(x, self.line_len, LocalR2rError), 1).ravel()

    def backward(self, x):
        return self.forward(x)

    def inverse(self, x):
        return self.forward(x) / self.line_len


def transform_lines(df: DataFrame, plan, operation: str = "forward", re: str = "re", im: str | None = None) -> DataFrame:
    """Apply a local plan to each row's line, held in array columns ``re`` and, for complex lines, ``im``.

    Lines are whole rows, so no row moves: a projection.  The other columns are kept; the result is in ``re`` and, if
    it is complex, ``im``.  Each row's array is some whole number of lines; a null array counts as an empty one.
    """
    ship(df.sparkSession)
    keep = [c for c in df.columns if c not in (re, im)]
    fields_ = [df.schema[c] for c in keep]
    probe = getattr(plan, operation)(np.zeros(0, complex if im else float))
    complex_out = np.iscomplexobj(probe)
    out_names = [re, *([im or "im"] if complex_out else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            values = [batch.column(batch.schema.get_field_index(c)) for c in ((re, im) if im else (re,))]
            counts = [np.diff(v.offsets.to_numpy()) for v in values]
            if im and (counts[0] != counts[1]).any():
                raise TransformError("a line's parts differ in length")
            flat = [v.flatten().to_numpy(zero_copy_only=False) for v in values]
            x = flat[0] + 1j * flat[1] if im else flat[0]
            y = getattr(plan, operation)(x)
            ratio = len(y) / max(1, len(x))
            ends_ = np.concatenate(([0], np.cumsum(np.round(counts[0] * ratio).astype(np.int64)))).astype(np.int32)
            parts = [y.real, y.imag] if complex_out else [y]
            lists = [pa.ListArray.from_arrays(pa.array(ends_), pa.array(np.ascontiguousarray(p))) for p in parts]
            yield pa.RecordBatch.from_arrays([*columns, *lists], [*keep, *out_names])

    schema = StructType([*fields_, *(StructField(c, ArrayType(DoubleType())) for c in out_names)])
    return df.select(*keep, re, *([im] if im else [])).mapInArrow(run, schema)


def _zeros(spark: SparkSession, shape: tuple[int, ...], extra: tuple[int, ...], dtype: str) -> NDArray:
    return NDArray.from_elem(spark, Layout.of(shape), 0j if dtype.startswith("c") else 0.0, extra, dtype)
