"""Array files: self-describing, raw, named containers, physical blocks, and collections.

All integers are little-endian 64-bit words.  A file is created exclusively, marked incomplete, filled, and marked
committed last; a reader takes committed files only and checks every word of the header.

Both ways a file is many byte ranges.  A writer gives the file its head and its full length first; executors then
write disjoint ranges of encoded cells, each range a partition that holds exactly the cells of these positions, and
writing a range again after a lost executor gives the same bytes.  The driver writes only the head and the commit word.
Readers split the payload into ranges that executors decode.  Files are written to a folder that all machines share;
they are read from there, or from any URI that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .._ship import ship
from ..errors import CatalogError, CollectionIoError, IoError, NamedIoError, typed
from ..operators.array import DTYPES, NDArray
from ..plans.layout import Layout, partition_range
from ..plans.transforms import stack
from .codec import Scalar

# Magics, versions, commit words and limits of the formats.
FILE_MAGIC, FILE_VERSION, PREFIX = b"PENCILIO", 1, 96
NAMED_MAGIC, RECORD_MAGIC, NAMED_VERSION, CONTAINER, RECORD = b"PIONAM02", b"PIOREC02", 2, 32, 72
CHUNK_MAGIC, CHUNK_VERSION = b"PNCHUNK3", 3
COMMIT, INCOMPLETE = 0x434F4D4D49545445, 0x494E434F4D504C45
MAX_HEADER, MAX_RANK, MAX_NAME, MAX_DATASETS = 1 << 20, 1024, 1024, 65_536

#: Cells encoded or decoded as one piece, and ranges of a file at most.
PIECE, MOST_RANGES = 1 << 18, 100_000


@dataclass(frozen=True)
class WriteOptions:
    """How a file is transferred, and hints to its store: taken and recorded as other array libraries do, and without
    effect, since every range is written by a task of its own anyway."""

    mode: str = "collective"
    hints: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if self.mode not in ("collective", "independent") or any(not k or "\0" in k + v for k, v in self.hints):
            raise IoError("no such transfer mode or hint")


def _words(*values: int) -> bytes:
    return b"".join(int(v).to_bytes(8, "little") for v in values)


def _word(data: bytes, at: int) -> int:
    if at < 0 or at + 8 > len(data):
        raise IoError("the file is too short")
    return int.from_bytes(data[at : at + 8], "little")


def _split(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _read(path: str, start: int = 0, length: int | None = None) -> bytes:
    system, where = _split(path)
    try:
        with system.open_input_file(where) as f:
            size = f.size()
            length = max(0, size - start) if length is None else length
            data = f.read_at(length, start) if length else b""
    except OSError as e:
        raise IoError(f"{path} can't be read: {e}") from None
    if len(data) != length:
        raise IoError(f"{path} is too short")
    return bytes(data)


def _size(path: str) -> int:
    system, where = _split(path)
    info = system.get_file_info(where)
    if not info.is_file:
        raise IoError(f"there is no file {path}")
    return info.size


def _local(path: str) -> str:
    from pyarrow import fs

    system, where = _split(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise IoError("files are written to mounted folders only; use the Parquet store elsewhere")
    return where


def _write_ranges(scalar: Scalar, where: str, start: int, span: int, total: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write the cells of one partition, which are sorted and must be all those of a range, to their place."""
    first = at = None
    f = None
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column(0).to_numpy()
            if f is None:
                first = at = int(places[0]) // span * span
                f = open(where, "r+b")
                f.seek(start + first * scalar.width)
            if int(places[0]) != at or (np.diff(places) != 1).any():
                raise IoError("IoError: the array isn't dense")
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            if scalar.name == "u64":
                columns = [np.array([int(x) for x in columns[0]], np.uint64)]
            f.write(scalar.encode(columns))
            at += len(places)
        if f is not None:
            if at != min(total, first + span):
                raise IoError("IoError: the array isn't dense")
            f.flush()
            os.fsync(f.fileno())
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([at - first], pa.int64())], ["at", "n"])
    finally:
        if f is not None:
            f.close()


def write_payload(path: str, start: int, array: NDArray, position=None) -> None:
    """Fill a file from byte ``start`` on with cells in order of ``position`` (logical row-major by default)."""
    ship(array.df.sparkSession)
    scalar, where, total = Scalar(array.dtype), _local(path), array.cells
    span = max(PIECE, -(-total // MOST_RANGES))
    rows = array.df.select((array.linear() if position is None else position).cast("long").alias("at"), *array.values)
    # positions are known to be dense, so ranges are dealt by arithmetic and nothing is sampled
    ranges = max(1, -(-total // span))
    dealt = rows.repartitionById(ranges, F.expr(f"cast(pmod(at div {span}, {ranges}) as int)")).sortWithinPartitions("at")
    done = dealt.mapInArrow(lambda it: _write_ranges(scalar, where, start, span, total, it), "at long, n long")
    with typed():
        n, different = done.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("at")).first()
    if n != total or different != -(-total // span):
        raise IoError("the array isn't dense")


def cells(spark: SparkSession, path: str, start: int, layout: Layout, extra: Sequence[int], dtype: str, big_endian: bool = False) -> NDArray:
    """The array whose payload begins at byte ``start`` of a file; each task reads its own byte ranges."""
    extra = tuple(extra)
    stored = (*extra, *layout.shape)
    return _decoded(spark, path, start, math.prod(stored), lambda first, last: np.unravel_index(np.arange(first, last), stored), layout, extra, dtype, big_endian)


def _decoded(spark: SparkSession, path: str, start: int, total: int, coordinates, layout: Layout, extra: tuple[int, ...], dtype: str, big_endian: bool) -> NDArray:
    """``total`` stored cells as an array; ``coordinates`` names those of a range of positions."""
    ship(spark)
    scalar = Scalar(dtype)
    if _size(path) < start + total * scalar.width:
        raise IoError(f"{path} is too short")
    names = [*(f"x{k}" for k in range(len(extra))), *(f"i{k}" for k in range(len(layout.shape)))]
    values = ["re", "im"] if dtype.startswith("c") else ["v"]
    arrow = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "decimal(20,0)": pa.decimal128(20, 0)}[DTYPES[dtype]]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                first, last = piece * PIECE, min(total, (piece + 1) * PIECE)
                columns = scalar.decode(_read(path, start + first * scalar.width, (last - first) * scalar.width), big_endian)
                out = [pa.array(np.asarray(c, np.int64)) for c in coordinates(first, last)]
                for c in columns:
                    out.append(pa.array([Decimal(int(x)) for x in c], arrow) if dtype == "u64" else pa.array(c).cast(arrow))
                yield pa.RecordBatch.from_arrays(out, [*names, *values])

    schema = ", ".join([*(f"{c} long" for c in names), *(f"{v} {DTYPES[dtype]}" for v in values)])
    df = spark.range(-(-total // PIECE)).mapInArrow(decode, schema) if total else spark.createDataFrame([], schema)
    return NDArray(df, layout, extra, dtype)


@dataclass(frozen=True)
class DatasetInfo:
    """What a catalog says of a dataset; ``provenance`` is the writer's layout as stored."""

    name: str | None
    dtype: str
    shape: tuple[int, ...]
    extra: tuple[int, ...]
    provenance: bytes
    start: int
    size: int

    def check(self, layout: Layout, extra: tuple[int, ...], dtype: str) -> None:
        if (self.dtype, self.shape, self.extra) != (dtype, layout.shape, tuple(extra)):
            raise IoError(f"the file holds {self.dtype} {self.extra} x {self.shape}, not {dtype} {tuple(extra)} x {layout.shape}")


def catalog_frame(spark: SparkSession, found: Sequence[DatasetInfo]) -> DataFrame:
    """name, dtype, global_shape, extra_shape and provenance of each dataset."""
    rows = [(x.name, x.dtype, list(x.shape), list(x.extra), bytearray(x.provenance)) for x in found]
    return spark.createDataFrame(rows, "name string, dtype string, global_shape array<bigint>, extra_shape array<bigint>, provenance binary")


def _create(path: str, head: bytes, mark_at: int | None, array: NDArray | None = None, position=None) -> None:
    """Write head and payload; the commit word at ``mark_at`` goes in last.  A failed write leaves an incomplete file."""
    where = _local(path)
    try:
        f = open(where, "xb")
    except FileExistsError:
        raise IoError(f"{path} exists") from None
    with f:
        f.write(head)
        if array is not None:
            f.truncate(len(head) + array.cells * Scalar(array.dtype).width)
        f.flush()
        os.fsync(f.fileno())
    if array is not None:
        write_payload(path, len(head), array, position)
    if mark_at is not None:
        _mark(where, mark_at, COMMIT)


def _mark(where: str, at: int, word: int) -> None:
    with open(where, "r+b") as f:
        f.seek(at)
        f.write(_words(word))
        f.flush()
        os.fsync(f.fileno())


# self-describing files


def write_array(path: str, array: NDArray, options: WriteOptions = WriteOptions()) -> None:
    scalar, layout = Scalar(array.dtype), array.layout
    tail = _words(*array.shape, *array.extra, *layout.grid.shape, *layout.permutation.axes)
    size = PREFIX + len(tail)
    if array.rank + len(array.extra) > MAX_RANK or size > MAX_HEADER:
        raise IoError("the array has too many axes")
    head = FILE_MAGIC + _words(FILE_VERSION, size, INCOMPLETE, array.rank, scalar.code, scalar.width, len(array.extra), size, array.cells * scalar.width, len(layout.grid.shape), 0)
    _create(path, head + tail, 24, array)


def describe(path: str) -> DatasetInfo:
    size = _size(path)
    prefix = _read(path, 0, PREFIX) if size >= PREFIX else b""
    if prefix[:8] != FILE_MAGIC:
        raise IoError(f"{path} is no array file")
    version, length, mark, n, code, width, e, start, held, m, zero = (_word(prefix, 8 * k) for k in range(1, 12))
    if version != FILE_VERSION:
        raise IoError(f"version {version} isn't read")
    if mark == INCOMPLETE:
        raise IoError(f"{path} was never committed")
    if mark != COMMIT or zero or not 1 <= n or n + e > MAX_RANK or not 1 <= m <= n or length != PREFIX + 8 * (2 * n + e + m) or length > MAX_HEADER or start != length:
        raise IoError(f"the header of {path} is damaged")
    scalar = Scalar.from_code(code, width)
    words = _read(path, PREFIX, length - PREFIX)
    values = [_word(words, 8 * k) for k in range(2 * n + e + m)]
    shape, extra, rest = tuple(values[:n]), tuple(values[n : n + e]), values[n + e :]
    if any(x < 1 for x in shape) or any(x < 1 for x in rest[:m]) or sorted(rest[m:]) != list(range(n)) or held != math.prod(shape) * math.prod(extra) * width:
        raise IoError(f"the header of {path} is damaged")
    if size != start + held:
        raise IoError(f"{path} has {size} bytes, not {start + held}")
    return DatasetInfo(None, scalar.name, shape, extra, _words(*rest), start, held)


def read_array(spark: SparkSession, path: str, layout: Layout, extra: Sequence[int] = (), dtype: str = "f64") -> NDArray:
    """Read under any layout of the stored shape and type."""
    info = describe(path)
    info.check(layout, tuple(extra), dtype)
    return cells(spark, path, info.start, layout, extra, dtype)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    try:
        return catalog_frame(spark, [describe(path)])
    except IoError as e:
        raise CatalogError(str(e)) from None


# headerless files


def write_raw(path: str, array: NDArray, head: bytes = b"", options: WriteOptions = WriteOptions()) -> None:
    """Nothing but cells, after whatever ``head`` the reader is to skip."""
    _create(path, head, None, array)


def read_raw(spark: SparkSession, path: str, layout: Layout, extra: Sequence[int] = (), dtype: str = "f64", byte_offset: int = 0, byte_order: str = "native") -> NDArray:
    if byte_order not in ("native", "little", "big") or byte_offset < 0:
        raise IoError("no such byte order or offset")
    import sys

    big = byte_order == "big" or byte_order == "native" and sys.byteorder == "big"
    return cells(spark, path, byte_offset, layout, extra, dtype, big)


# named containers


def _check_name(name: str) -> bytes:
    raw = name.encode()
    if not raw or len(raw) > MAX_NAME or b"\0" in raw:
        raise NamedIoError(f"{name!r} is no name for a dataset")
    return raw


def _record(name: str, array: NDArray) -> bytes:
    raw, scalar = _check_name(name), Scalar(array.dtype)
    meta = _words(array.rank, len(array.extra), *array.shape, *array.extra)
    held = array.cells * scalar.width
    total = RECORD + len(raw) + len(meta) + held + 8
    return RECORD_MAGIC + _words(NAMED_VERSION, len(raw), len(meta), held, total, scalar.code, scalar.width, 0) + raw + meta


def named_datasets(path: str) -> tuple[list[DatasetInfo], int, bool]:
    """Committed records, where they end, and whether the file ends there too."""
    size = _size(path)
    head = _read(path, 0, CONTAINER) if size >= CONTAINER else b""
    if head != NAMED_MAGIC + _words(NAMED_VERSION, CONTAINER, 0):
        raise NamedIoError(f"{path} is no container")
    out, at = [], CONTAINER
    while at < size:
        if at + RECORD > size:
            return out, at, False
        h = _read(path, at, RECORD)
        version, names, metas, held, total, code, width, zero = (_word(h, 8 * k) for k in range(1, 9))
        fits = h[:8] == RECORD_MAGIC and version == NAMED_VERSION and not zero and 0 < names <= MAX_NAME and 16 <= metas <= MAX_HEADER and total == RECORD + names + metas + held + 8
        if not fits or at + total > size or _word(_read(path, at + total - 8, 8), 0) != COMMIT:
            return out, at, False
        scalar = Scalar.from_code(code, width)
        body = _read(path, at + RECORD, names + metas)
        n, e = _word(body, names), _word(body, names + 8)
        if metas != 16 + 8 * (n + e):
            raise NamedIoError(f"a record of {path} is damaged")
        extents = [_word(body, names + 16 + 8 * k) for k in range(n + e)]
        if math.prod(extents) * width != held or len(out) == MAX_DATASETS:
            raise NamedIoError(f"a record of {path} is damaged")
        out.append(DatasetInfo(body[:names].decode(), scalar.name, tuple(extents[:n]), tuple(extents[n:]), b"", at + RECORD + names + metas, held))
        at += total
    return out, at, True


def write_named(path: str, name: str, array: NDArray) -> None:
    """Create a container with its first dataset."""
    record = _record(name, array)
    _create(path, NAMED_MAGIC + _words(NAMED_VERSION, CONTAINER, 0), None)
    _append(path, CONTAINER, record, array)


def append_named(path: str, name: str, array: NDArray) -> None:
    """Add a dataset; a damaged tail blocks this, though what stands before it can still be read."""
    found, end, whole = named_datasets(path)
    if not whole:
        raise NamedIoError(f"{path} has a damaged tail")
    if any(x.name == name for x in found):
        raise NamedIoError(f"{path} has a dataset {name!r}")
    _append(path, end, _record(name, array), array)


def _append(path: str, at: int, record: bytes, array: NDArray) -> None:
    where, end = _local(path), at + len(record) + array.cells * Scalar(array.dtype).width
    with open(where, "r+b") as f:
        f.seek(at)
        f.write(record)
        f.truncate(end + 8)
        f.flush()
        os.fsync(f.fileno())
    _mark(where, end, INCOMPLETE)
    write_payload(path, at + len(record), array)
    _mark(where, end, COMMIT)


def _named(path: str, name: str) -> DatasetInfo:
    info = next((x for x in named_datasets(path)[0] if x.name == name), None)
    if info is None:
        raise NamedIoError(f"{path} has no dataset {name!r}")
    return info


def read_named(spark: SparkSession, path: str, name: str, layout: Layout, extra: Sequence[int] = (), dtype: str = "f64") -> NDArray:
    info = _named(path, name)
    info.check(layout, tuple(extra), dtype)
    return cells(spark, path, info.start, layout, extra, dtype)


def named_catalog(spark: SparkSession, path: str) -> DataFrame:
    found, _, whole = named_datasets(path)
    if not whole:
        raise CatalogError(f"{path} has a damaged tail")
    return catalog_frame(spark, found)


class FileSession:
    """A container held open over several operations; one that failed while writing takes no more."""

    def __init__(self, spark: SparkSession, path: str, mode: str):
        if mode not in ("create", "read", "append"):
            raise NamedIoError(f"no mode {mode}")
        self.spark, self.path, self.mode, self.closed, self.poisoned = spark, path, mode, False, False
        if mode == "create":
            _create(path, NAMED_MAGIC + _words(NAMED_VERSION, CONTAINER, 0), None)
        elif not named_datasets(path)[2] and mode == "append":
            raise NamedIoError(f"{path} has a damaged tail")

    def __enter__(self) -> FileSession:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _usable(self, writing: bool = False) -> None:
        if self.closed or self.poisoned or writing and self.mode == "read":
            raise NamedIoError("the session doesn't take this")

    def write(self, name: str, array: NDArray) -> None:
        self._usable(True)
        self.poisoned = True
        append_named(self.path, name, array)
        self.poisoned = False

    def read(self, name: str, layout: Layout, extra: Sequence[int] = (), dtype: str = "f64") -> NDArray:
        self._usable()
        return read_named(self.spark, self.path, name, layout, extra, dtype)

    def catalog(self) -> DataFrame:
        self._usable()
        return named_catalog(self.spark, self.path)

    def flush(self) -> None:
        self._usable()

    def close(self) -> None:
        self.closed = True


# physical blocks


def _chunk_head(layout: Layout, extra: tuple[int, ...], scalar: Scalar) -> tuple[bytes, list[tuple[int, int, list[tuple[int, int]]]]]:
    """The header, and each block's first byte, cells and ranges."""
    n, m, grid = len(layout.shape), len(layout.grid.shape), layout.grid
    size = 8 * (12 + 2 * n + len(extra) + 2 * m + grid.size * (m + 2 * n + 2))
    if size > MAX_HEADER:
        raise IoError("the grid has too many blocks for one file")
    blocks, out, at = b"", [], size
    for rank in range(grid.size):
        coords = grid.coords_of(rank)
        ranges = layout.ranges_at(coords)
        count = math.prod(extra) * math.prod(b - a for a, b in ranges)
        blocks += _words(*coords, *(x for r in ranges for x in r), count, at)
        out.append((at, count, ranges))
        at += count * scalar.width
    head = CHUNK_MAGIC + _words(CHUNK_VERSION, size, at, scalar.code, scalar.width, n, len(extra), m, grid.size, 1, 0)
    head += _words(*layout.shape, *extra, *grid.shape, *layout.decomposition.axes, *layout.permutation.axes)
    return head + blocks, out


def _block_position(array: NDArray):
    """Position of a cell in the concatenation of all blocks, each in its own physical order.

    The cells in blocks before a block follow from its coordinates: along the first cut axis whole slices of the array,
    along the next one slices of the block's own slice, and so on.
    """
    layout, extra = array.layout, array.extra
    grid = dict(zip(layout.decomposition.axes, layout.grid.shape, strict=True))
    first, length = {}, {}
    for a, n in enumerate(layout.shape):
        i, p = F.col(f"i{a}"), grid.get(a, 1)
        c = F.floor(((i + 1) * p - 1) / n).cast("long")
        first[a] = F.expr("0L") if p == 1 else F.floor(c * n / p).cast("long")
        length[a] = F.lit(n).cast("long") if p == 1 else F.floor((c + 1) * n / p).cast("long") - first[a]
    before, slice_, rest = F.lit(0).cast("long"), F.lit(1).cast("long"), array.cells
    for a in layout.decomposition.axes:
        rest //= layout.shape[a]
        before = before + slice_ * first[a] * rest
        slice_ = slice_ * length[a]
    inside = F.lit(0).cast("long")
    for c, n in zip(array.batch, extra, strict=True):
        inside = inside * n + F.col(c)
    for a in layout.permutation.axes:
        inside = inside * length[a] + (F.col(f"i{a}") - first[a])
    return before + inside


def write_chunked(path: str, array: NDArray, options: WriteOptions = WriteOptions()) -> None:
    """One contiguous block of the file for each block of the layout, in physical order."""
    head, _ = _chunk_head(array.layout, array.extra, Scalar(array.dtype))
    where = _local(path)
    partial = where + ".incomplete"
    if os.path.exists(where):
        raise IoError(f"{path} exists")
    _create(partial, head, None, array, _block_position(array))
    os.link(partial, where)
    os.remove(partial)


def read_chunked(spark: SparkSession, path: str, layout: Layout, extra: Sequence[int] = (), dtype: str = "f64") -> NDArray:
    """Read under exactly the writer's grid, decomposition and memory order: one scan of pieces of the payload, each of
    which finds its blocks."""
    extra, scalar = tuple(extra), Scalar(dtype)
    head, blocks = _chunk_head(layout, extra, scalar)
    if _size(path) != blocks[-1][0] + blocks[-1][1] * scalar.width or _read(path, 0, len(head)) != head:
        raise IoError(f"{path} was written with another layout, shape or type")
    ship(spark)
    counts = np.array([n for _, n, _ in blocks], np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)))
    ranges = [r for _, _, r in blocks]
    shared = spark.sparkContext.broadcast((starts, ranges))  # as small as the header, 1 MB at most
    order = layout.permutation.axes
    e, rank = len(extra), len(layout.shape)

    def coordinates(first: int, last: int) -> list[np.ndarray]:
        starts, ranges = shared.value
        out: list[list[np.ndarray]] = [[] for _ in range(e + rank)]
        b = int(np.searchsorted(starts, first, "right")) - 1
        while first < last:
            until = min(last, int(starts[b + 1]))
            if until > first:
                sides = [(lo, hi - lo) for lo, hi in ranges[b]]
                at = np.unravel_index(np.arange(first, until) - int(starts[b]), (*extra, *(sides[a][1] for a in order)))
                for k in range(e):
                    out[k].append(at[k])
                for k, a in enumerate(order):
                    out[e + a].append(at[e + k] + sides[a][0])
            first, b = until, b + 1
        return [np.concatenate(c) for c in out]

    return _decoded(spark, path, len(head), int(starts[-1]), coordinates, layout, extra, dtype, False)


def chunked_catalog(spark: SparkSession, path: str) -> DataFrame:
    size = _size(path)
    first = _read(path, 0, 96) if size >= 96 else b""
    if first[:8] != CHUNK_MAGIC or _word(first, 8) != CHUNK_VERSION or _word(first, 24) != size:
        raise CatalogError(f"{path} is no file of blocks")
    scalar = Scalar.from_code(_word(first, 32), _word(first, 40))
    n, e, m = (_word(first, 8 * k) for k in (6, 7, 8))
    words = _read(path, 96, 8 * (2 * n + e + 2 * m))
    v = [_word(words, 8 * k) for k in range(2 * n + e + 2 * m)]
    layout = Layout.of(v[:n], v[n + e : n + e + m], v[n + e + m : n + e + 2 * m], v[n + e + 2 * m :])
    extra = tuple(v[n : n + e])
    if _read(path, 0, _word(first, 16)) != _chunk_head(layout, extra, scalar)[0]:
        raise CatalogError(f"the header of {path} is damaged")
    return catalog_frame(spark, [DatasetInfo(None, scalar.name, layout.shape, extra, _words(*layout.grid.shape, *layout.permutation.axes), 0, 0)])


# collections


def write_collection(path: str, arrays: Sequence[NDArray]) -> None:
    """Members of one layout and type as one array with a leading member axis."""
    write_array(path, _collected(arrays))


def _collected(arrays: Sequence[NDArray]) -> NDArray:
    if not arrays:
        raise CollectionIoError("a collection needs a member")
    if any((a.layout, a.extra, a.dtype) != (arrays[0].layout, arrays[0].extra, arrays[0].dtype) for a in arrays):
        raise IoError("the members differ in layout, batch shape or type")
    return stack(arrays)


def _member_cells(spark: SparkSession, path: str, info: DatasetInfo, count: int, layout: Layout, extra: tuple[int, ...], dtype: str) -> list[NDArray]:
    """Each member from its own byte range, so that reading one reads nothing of the others."""
    info.check(layout, (count, *extra), dtype)
    size = math.prod(extra) * math.prod(layout.shape) * Scalar(dtype).width
    return [cells(spark, path, info.start + m * size, layout, extra, dtype) for m in range(count)]


def read_collection(spark: SparkSession, path: str, count: int, layout: Layout, extra: Sequence[int] = (), dtype: str = "f64") -> list[NDArray]:
    return _member_cells(spark, path, describe(path), count, layout, tuple(extra), dtype)


def read_stacked(spark: SparkSession, path: str, count: int, layout: Layout, extra: Sequence[int] = (), dtype: str = "f64") -> NDArray:
    """All members in one scan, under a leading member axis."""
    return read_array(spark, path, layout, (count, *extra), dtype)


def write_named_collection(path: str, name: str, arrays: Sequence[NDArray]) -> None:
    write_named(path, name, _collected(arrays))


def append_named_collection(path: str, name: str, arrays: Sequence[NDArray]) -> None:
    append_named(path, name, _collected(arrays))


def read_named_collection(spark: SparkSession, path: str, name: str, count: int, layout: Layout, extra: Sequence[int] = (), dtype: str = "f64") -> list[NDArray]:
    return _member_cells(spark, path, _named(path, name), count, layout, tuple(extra), dtype)
