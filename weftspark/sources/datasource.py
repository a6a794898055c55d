"""Array files as a Spark data source: ``spark.read.format("weft_array")``.

A file is a table of cells.  Options named after coordinates bound what is read of it, as an index (``i0`` = ``2``) or a
range (``i1`` = ``3:5``, ``:5``, ``3:``): only the byte ranges of the cells within these bounds are taken.  Cells within
bounds are runs of consecutive bytes, as long as the axes after the last bounded one allow; partitions are spans of them.
Runs less than a page apart are read together with what lies between them.

Bounds are options and not pushed filters because Spark 4.1 keeps what was first pushed to a loaded Python source for
all later queries of that DataFrame, so that they miss rows; ``scan`` loads anew for each slice.

Other options: ``path``; ``dataset``, a name in a container of several arrays; or, for a file without a header,
``shape``, ``extra`` and ``dtype``, with ``byteOffset`` and ``byteOrder``.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .._ship import ship
from ..errors import IoError
from ..operators.array import DTYPES, NDArray
from ..plans.layout import Layout
from . import files
from .codec import Scalar

FORMAT = "weft_array"

#: Bytes between two runs that are read over rather than skipped, and of the window whose runs are read at once.
GAP, READ = 4096, 1 << 22
_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0)}


@dataclass(frozen=True)
class Place:
    """An array in a file."""

    path: str
    start: int
    dtype: str
    extra: tuple[int, ...]
    shape: tuple[int, ...]
    big_endian: bool = False

    @classmethod
    def of(cls, options) -> Place:
        path = options.get("path")
        if not path:
            raise IoError("a path is needed")
        if options.get("shape") is not None:
            extents = lambda k: tuple(int(x) for x in (options.get(k) or "").split(",") if x.strip())
            order = options.get("byteOrder", "native")
            if order not in ("native", "little", "big"):
                raise IoError("no such byte order")
            out = cls(path, int(options.get("byteOffset", 0)), options.get("dtype", "f64"), extents("extra"), extents("shape"), order == "big" or order == "native" and sys.byteorder == "big")
            if files._size(path) < out.start + math.prod(out.dims) * Scalar(out.dtype).width:
                raise IoError(f"{path} is too short")
            return out
        name = options.get("dataset")
        info = files.describe(path) if name is None else files._named(path, name)
        return cls(path, info.start, info.dtype, info.extra, info.shape)

    @property
    def dims(self) -> tuple[int, ...]:
        return (*self.extra, *self.shape)

    @property
    def coords(self) -> list[str]:
        return [*(f"x{k}" for k in range(len(self.extra))), *(f"i{k}" for k in range(len(self.shape)))]

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.dtype.startswith("c") else ["v"]


@dataclass(frozen=True)
class Box:
    """Cells within bounds (low, high) of each axis, numbered in row-major order."""

    dims: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]

    @property
    def spans(self) -> tuple[int, ...]:
        return tuple(max(0, b - a) for a, b in zip(self.low, self.high, strict=True))

    @property
    def cells(self) -> int:
        return math.prod(self.spans)

    @property
    def run(self) -> int:
        """Cells that are consecutive in the file."""
        size, spans = 1, self.spans
        for k in reversed(range(len(spans))):
            size *= spans[k]
            if spans[k] != self.dims[k]:
                break
        return size

    def coordinates(self, first: int, last: int) -> list[np.ndarray]:
        return self._coordinates(np.arange(first, last))

    def _coordinates(self, cells: np.ndarray) -> list[np.ndarray]:
        found = np.unravel_index(cells, self.spans) if self.dims else ()
        return [c + a for c, a in zip(found, self.low, strict=True)]

    def runs(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the file's array, and numbers, of the cells ``first`` to ``last``, run by run."""
        run = max(1, self.run)
        at = np.arange(first // run * run, last, run) if first < last else np.arange(0)
        at[:1] = first
        place = np.zeros(len(at), np.int64)
        for c, size in zip(self._coordinates(at), self.dims, strict=True):
            place = place * size + c
        return place, np.diff(at, append=last)

    def ranges(self, first: int, last: int) -> list[tuple[int, int]]:
        """The runs as pairs."""
        return list(zip(*(x.tolist() for x in self.runs(first, last)), strict=True))


def read_runs(f, start: int, width: int, place: np.ndarray, n: np.ndarray) -> bytes:
    """The bytes of runs of cells in ascending order, by one read for those that lie close together."""
    gap = (place[1:] - place[:-1] - n[:-1]) * width
    cuts = np.flatnonzero((gap > GAP) | (np.diff(place * width // READ) != 0)) + 1
    out = []
    for a, b in itertools.pairwise([0, *cuts.tolist(), len(place)]):
        low, total = int(place[a]), int(place[b - 1] + n[b - 1] - place[a])
        data = f.read_at(total * width, start + low * width)
        if len(data) == total * width and b - a > 1:
            size = n[a:b]
            taken = np.arange(size.sum()) + np.repeat(place[a:b] - low - np.cumsum(size) + size, size)
            data = np.frombuffer(data, f"V{width}")[taken].tobytes()
        out.append(data)
    return b"".join(out)


@dataclass
class Span(InputPartition):
    first: int
    last: int


def bounds(place: Place, options) -> Box:
    """The box that options of coordinates' names bound."""
    low, high = [], []
    for c, n in zip(place.coords, place.dims, strict=True):
        first, colon, last = str(options.get(c, ":")).partition(":")
        try:
            a = int(first) if first.strip() else 0
            b = a + 1 if not colon else int(last) if last.strip() else n
        except ValueError:
            raise IoError(f"{c} isn't bounded by {options.get(c)!r}") from None
        low.append(min(max(a, 0), n))
        high.append(max(low[-1], min(b, n)) if a >= 0 or colon else low[-1])
    return Box(place.dims, tuple(low), tuple(high))


class ArrayReader(DataSourceReader):
    def __init__(self, place: Place, options):
        self.place, self.box = place, bounds(place, options)

    def partitions(self) -> list[Span]:
        n = self.box.cells
        span = max(files.PIECE, -(-n // files.MOST_RANGES))
        return [Span(a, min(n, a + span)) for a in range(0, n, span)] or [Span(0, 0)]

    def ranges(self) -> list[tuple[int, int]]:
        """Byte ranges (first, number) that all partitions read."""
        width = Scalar(self.place.dtype).width
        return [(self.place.start + at * width, n * width) for p in self.partitions() for at, n in self.box.ranges(p.first, p.last)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        place, scalar = self.place, Scalar(self.place.dtype)
        kind = _ARROW[DTYPES[place.dtype]]
        system, where = files._split(place.path)
        with system.open_input_file(where) as f:
            for first in range(partition.first, partition.last, files.PIECE):
                last = min(partition.last, first + files.PIECE)
                data = read_runs(f, place.start, scalar.width, *self.box.runs(first, last))
                if len(data) != (last - first) * scalar.width:
                    raise IoError(f"IoError: {place.path} is too short")
                out = [pa.array(np.asarray(c, np.int64)) for c in self.box.coordinates(first, last)]
                for c in scalar.decode(data, place.big_endian):
                    out.append(pa.array([Decimal(int(x)) for x in c], kind) if place.dtype == "u64" else pa.array(np.ascontiguousarray(c)).cast(kind))
                yield pa.RecordBatch.from_arrays(out, [*place.coords, *place.values])


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        place = Place.of(self.options)
        return ", ".join([*(f"{c} bigint" for c in place.coords), *(f"{v} {DTYPES[place.dtype]}" for v in place.values)])

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(Place.of(self.options), self.options)


def install(spark: SparkSession) -> None:
    """Make the format known to the session."""
    ship(spark)
    spark.dataSource.register(ArraySource)


def scan(spark: SparkSession, path: str, dataset: str | None = None, where: dict[str, int | tuple[int | None, int | None]] | None = None, **options) -> NDArray:
    """An array file as an array, or the cells of it that ``where`` bounds: an index or (first, end) for each coordinate.

    A slice's table has the whole array's coordinates.
    """
    install(spark)
    text = lambda x: str(x) if isinstance(x, int) else ":".join("" if i is None else str(i) for i in x)
    named = {"path": path} | ({"dataset": dataset} if dataset is not None else {}) | {k: str(v) for k, v in options.items()}
    place = Place.of(named)
    if unknown := set(where or {}) - set(place.coords):
        raise IoError(f"the array has no coordinates {sorted(unknown)}")
    named |= {c: text(x) for c, x in (where or {}).items()}
    return NDArray(spark.read.format(FORMAT).options(**named).load(), Layout.of(place.shape), place.extra, place.dtype)
