"""Arrays as Parquet folders: the native form, on any storage that Spark reaches.

Cells are dealt by range of their position and sorted before they are written, so row groups cover narrow coordinate
ranges and filters on coordinates skip them.  Positions of a dense array are known, so the ranges are arithmetic and
nothing is sampled.  An array of tiles is kept as such.  The description is written last, as the commit mark.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CollectionIoError, IoError
from ..operators.array import NDArray
from ..operators.tiles import Tiles, Tiling
from ..plans.layout import Layout
from ..plans.transforms import stack, unstack
from .files import MAX_DATASETS, MAX_NAME

#: Groups above an array of a tree, cells of a file unless the number of files is given, and such files at most.
MAX_DEPTH, FILE_CELLS, MOST_FILES = 32, 1 << 23, 100_000


@dataclass(frozen=True)
class Options:
    """How cells are stored: codec, bytes of a row group (the unit that filters skip), and number of files."""

    codec: str = "zstd"
    row_group_bytes: int | None = None
    partitions: int | None = None

    def __post_init__(self):
        if self.codec not in ("zstd", "snappy", "gzip", "none") or (self.row_group_bytes or 1) < 1 or (self.partitions or 1) < 1:
            raise IoError("no such storage options")


def _linear(array: NDArray) -> str:
    """The position in logical order, as SQL."""
    out = "0L"
    for c, n in zip(array.coords, (*array.extra, *array.shape), strict=True):
        out = f"({out}) * {n}L + {c}"
    return out


def write(array: NDArray, path: str, options: Options = Options()) -> None:
    spark, partitions = array.df.sparkSession, options.partitions
    partitions = partitions or max(1, min(MOST_FILES, -(-array.cells // FILE_CELLS)))
    span = max(1, -(-array.cells // partitions))
    rows = array.table().repartitionById(partitions, F.expr(f"cast(pmod(({_linear(array)}) div {span}, {partitions}) as int)"))
    writer = rows.sortWithinPartitions(*array.coords).write.mode("errorifexists").option("compression", options.codec)
    if options.row_group_bytes:
        writer = writer.option("parquet.block.size", options.row_group_bytes)
    writer.parquet(path)
    layout = array.layout
    about = {"shape": layout.shape, "grid": layout.grid.shape, "axes": layout.decomposition.axes, "permutation": layout.permutation.axes, "extra": array.extra, "dtype": array.dtype}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/_about")


def _about(spark: SparkSession, path: str) -> dict:
    try:
        return json.loads(spark.read.text(f"{path}/_about").first()[0])
    except (AnalysisException, TypeError):
        raise IoError(f"{path} holds no committed array") from None


def read(spark: SparkSession, path: str) -> NDArray:
    about = _about(spark, path)
    if "chunk" in about:
        return read_tiles(spark, path).to_cells()
    layout = Layout.of(about["shape"], about["grid"], about["axes"], about["permutation"])
    return NDArray(spark.read.parquet(path), layout, tuple(about["extra"]), about["dtype"])


def write_tiles(tiles: Tiles, path: str, options: Options = Options()) -> None:
    """Tiles in the order of their blocks; filters on ``block_id`` skip row groups."""
    spark = tiles.df.sparkSession
    partitions = options.partitions or max(1, min(MOST_FILES, -(-tiles.cells // FILE_CELLS)))
    span = max(1, -(-math.prod(tiles.tiling.counts) // partitions))
    rows = tiles.df.select("block_id", "origin", "extent", *tiles.values).repartitionById(partitions, F.expr(f"cast(pmod(block_id div {span}, {partitions}) as int)"))
    writer = rows.sortWithinPartitions("block_id").write.mode("errorifexists").option("compression", options.codec)
    if options.row_group_bytes:
        writer = writer.option("parquet.block.size", options.row_group_bytes)
    writer.parquet(path)
    layout = tiles.layout
    about = {"shape": layout.shape, "grid": layout.grid.shape, "axes": layout.decomposition.axes, "permutation": layout.permutation.axes, "extra": tiles.extra, "dtype": tiles.dtype, "chunk": tiles.tiling.chunk}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/_about")


def read_tiles(spark: SparkSession, path: str) -> Tiles:
    about = _about(spark, path)
    if "chunk" not in about:
        raise IoError(f"{path} holds cells, no tiles")
    layout = Layout.of(about["shape"], about["grid"], about["axes"], about["permutation"])
    extra = tuple(about["extra"])
    return Tiles(spark.read.parquet(path), layout, Tiling((*extra, *layout.shape), tuple(about["chunk"])), extra, about["dtype"])


def _part(name: str) -> str:
    raw = name.encode()
    if not raw or len(raw) > MAX_NAME or b"\0" in raw:
        raise IoError(f"{name!r} is no name for a dataset")
    return raw.hex()


class _Folder:
    """Listing through Hadoop's file systems, so that any storage that Spark reaches will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._files.exists(self._paths(path))

    def make(self, path: str) -> None:
        self._files.mkdirs(self._paths(path))

    def folders(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(x.getPath().getName() for x in self._files.listStatus(self._paths(path)) if x.isDirectory())


class Store(_Folder):
    """A folder of named arrays; a name's folder is the hex of its UTF-8 bytes."""

    def _at(self, name: str) -> str:
        return f"{self.path}/{_part(name)}"

    def write(self, name: str, array: NDArray | Tiles, options: Options = Options()) -> None:
        at = self._at(name)
        if self.exists(at):
            raise IoError(f"{name!r} exists")
        if isinstance(array, Tiles):
            write_tiles(array, at, options)
        else:
            write(array, at, options)

    def read_tiles(self, name: str) -> Tiles:
        """An array that was kept as tiles; ``read`` gives its cells."""
        return read_tiles(self.spark, self._at(name))

    def read(self, name: str) -> NDArray:
        return read(self.spark, self._at(name))

    def write_collection(self, name: str, arrays: Sequence[NDArray], options: Options = Options()) -> None:
        """Members of one layout and type, under a leading member axis."""
        if not arrays or any((a.layout, a.extra, a.dtype) != (arrays[0].layout, arrays[0].extra, arrays[0].dtype) for a in arrays):
            raise CollectionIoError("a collection needs members of one layout, batch shape and type")
        self.write(name, stack(arrays), options)

    def read_collection(self, name: str) -> list[NDArray]:
        return unstack(self.read(name))

    def names(self) -> list[str]:
        return [bytes.fromhex(x).decode() for x in self.folders(self.path)]

    def catalog(self) -> DataFrame:
        rows = [_described(n, self.read(n)) for n in self.names()]
        return self.spark.createDataFrame(rows, _CATALOG)


_CATALOG = "name string, dtype string, global_shape array<bigint>, extra_shape array<bigint>"


def _described(name: str, a: NDArray) -> tuple:
    return (name, a.dtype, list(a.shape), list(a.extra))


class TreeSession(_Folder):
    """A tree of groups and arrays, named by paths like ``run/3/velocity``, open for one mode of use."""

    def __init__(self, spark: SparkSession, path: str, mode: str):
        super().__init__(spark, path)
        if mode not in ("create", "read", "append"):
            raise IoError(f"no mode {mode}")
        self.mode, self.open = mode, True
        if mode == "create":
            if self.exists(self.path):
                raise IoError(f"{path} exists")
            self.make(f"{self.path}/_group")
        elif not self.exists(f"{self.path}/_group"):
            raise IoError(f"{path} is no tree of arrays")

    def __enter__(self) -> TreeSession:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.open = False

    def _at(self, name: str, writing: bool = False) -> str:
        parts = name.split("/")
        if not self.open or writing and self.mode == "read":
            raise IoError("the session doesn't take this")
        if len(parts) > MAX_DEPTH:
            raise IoError(f"{name!r} is deeper than {MAX_DEPTH} groups")
        for k in range(1, len(parts)):
            if not self.exists("/".join([self.path, *map(_part, parts[:k]), "_group"])):
                raise IoError(f"there is no group {'/'.join(parts[:k])!r}")
        at = "/".join([self.path, *map(_part, parts)])
        if writing and self.exists(at):
            raise IoError(f"{name!r} exists")
        return at

    def create_group(self, name: str) -> None:
        self.make(f"{self._at(name, True)}/_group")

    def write(self, name: str, array: NDArray, options: Options = Options()) -> None:
        write(array, self._at(name, True), options)

    def read(self, name: str) -> NDArray:
        return read(self.spark, self._at(name))

    def catalog(self) -> DataFrame:
        """All arrays of the tree, by path."""
        rows, todo = [], [("", self.path)]
        while todo:
            prefix, path = todo.pop()
            for x in self.folders(path):
                if x.startswith("_"):
                    continue
                name = prefix + bytes.fromhex(x).decode()
                if self.exists(f"{path}/{x}/_group"):
                    todo.append((f"{name}/", f"{path}/{x}"))
                else:
                    rows.append(_described(name, self.read(name)))
                if len(rows) + len(todo) > MAX_DATASETS:
                    raise IoError("the tree has too many objects")
        return self.spark.createDataFrame(sorted(rows), _CATALOG)
