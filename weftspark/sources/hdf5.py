"""Arrays in HDF5 files: a catalog, and datasets read as byte ranges by the executors.

The subset that array libraries write: superblocks 0 to 3, object headers 1 and 2, groups as symbol tables or compact
links, datasets that are contiguous or chunked under a B-tree of version 1, with shuffle and deflate.  Anything else is
refused by name.  The driver reads metadata only, and of a chunked dataset the inner nodes of its B-tree; leaf nodes are
rows of a table, and the task that gets one reads it and the chunks it lists.

Arrays lie in one of three groups: a single one, named ones, or a hierarchy of groups; each dataset's attributes say
what it holds.  Files are read from any place that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .._ship import ship
from ..errors import CatalogError, IoError
from ..operators.array import DTYPES, NDArray
from ..plans.layout import Layout
from . import files
from .codec import Scalar
from .files import COMMIT, INCOMPLETE, MAX_DATASETS, MAX_NAME, MAX_RANK, DatasetInfo

# Groups, the single array's name, and what the names of a dataset's attributes begin with.
SINGLE, NAMED, TREE, DATA = "pencil_io_v1", "pencil_io_named_v1", "pencil_io_tree_v1", "data"
VERSION = 1
ATTRIBUTE = "pencil_io_"
#: Groups above an array of a hierarchy.
MAX_DEPTH = 32

_SIGNATURE = b"\x89HDF\r\n\x1a\n"
_NOWHERE = (1 << 64) - 1
# message types of object headers
_SPACE, _LINKS, _TYPE, _LINK, _LAYOUT, _FILTERS, _ATTRIBUTE, _CONTINUED, _TABLE = 1, 2, 3, 6, 8, 11, 12, 16, 17
_DEFLATE, _SHUFFLE = 1, 2


@dataclass(frozen=True)
class Stored:
    """A dataset's place: bytes at ``address``, or chunks of extents ``chunk`` under the B-tree there."""

    dims: tuple[int, ...]
    dtype: str
    big_endian: bool
    address: int
    size: int
    chunk: tuple[int, ...] | None = None
    filters: tuple[int, ...] = ()


def _uint(data: bytes, at: int, size: int = 8) -> int:
    if at < 0 or at + size > len(data):
        raise IoError("the file is too short")
    return int.from_bytes(data[at : at + size], "little")


def _padded(n: int) -> int:
    return -(-n // 8) * 8


def _dims(space: bytes) -> tuple[int, ...]:
    version, rank = space[0], space[1]
    if version not in (1, 2):
        raise IoError(f"dataspaces of version {version} aren't read")
    if version == 2 and space[3] == 2:
        raise IoError("a null dataspace holds no array")
    start = 8 if version == 1 else 4
    return tuple(_uint(space, start + 8 * k) for k in range(rank))


def _element(kind: bytes) -> tuple[str, int, bool]:
    """Kind of number (i, u, f, c), bytes and whether big-endian."""
    cls, bits, size = kind[0] & 15, kind[1], _uint(kind, 4, 4)
    if cls == 0:
        return ("i" if bits & 8 else "u"), size, bool(bits & 1)
    if cls == 1:
        return "f", size, bool(bits & 1)
    if cls == 6 and _uint(kind, 1, 2) == 2 and kind[8:9] == b"r":
        # two floating-point members r and i, packed: each starts with its padded name and offset
        version = kind[0] >> 4
        head = {1: 8 + 4 + 28, 2: 8 + 4, 3: 2 + max(1, (size.bit_length() + 7) // 8)}.get(version)
        if head is not None:
            return "c", size, bool(kind[8 + head + 1] & 1)
    raise IoError(f"elements of class {cls} aren't read")


class H5File:
    """Metadata of a file, read as it is asked for."""

    def __init__(self, path: str):
        self.path, self.size = path, files._size(path)
        head = files._read(path, 0, min(self.size, 160))
        if head[:8] != _SIGNATURE:
            raise IoError(f"{path} is no HDF5 file")
        version = head[8]
        if version in (0, 1):
            widths, at = (head[13], head[14]), 24 + 4 * version
            self.base, self.root = _uint(head, at), _uint(head, at + 40)
        elif version in (2, 3):
            widths, self.base, self.root = (head[9], head[10]), _uint(head, 12), _uint(head, 36)
        else:
            raise IoError(f"superblocks of version {version} aren't read")
        if widths != (8, 8):
            raise IoError("addresses of other than 8 bytes aren't read")

    def at(self, address: int, length: int) -> bytes:
        if address == _NOWHERE or self.base + address + length > self.size:
            raise IoError(f"{self.path} points outside itself")
        return files._read(self.path, self.base + address, length)

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(type, data) of an object header with its continuations."""
        head = self.at(address, 16)
        modern = head[:4] == b"OHDR"
        if modern:
            flags = head[5]
            start = 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            wide = 1 << (flags & 3)
            more = self.at(address, start + wide)
            todo = [(address + start + wide, _uint(more, start, wide))]
        elif head[0] == 1:
            flags, todo = 0, [(address + 16, _uint(head, 8, 4))]
        else:
            raise IoError(f"object headers of version {head[0]} aren't read")
        out, seen = [], set()
        while todo:
            start, length = todo.pop(0)
            if start in seen or len(seen) > MAX_DATASETS:
                raise IoError("an object header continues in itself")
            seen.add(start)
            block, at, size = self.at(start, length), 0, 4 + (2 if flags & 4 else 0) if modern else 8
            while at + size <= len(block):
                kind, n = (block[at], _uint(block, at + 1, 2)) if modern else (_uint(block, at, 2), _uint(block, at + 2, 2))
                data = block[at + size : at + size + n]
                if len(data) < n:
                    raise IoError("an object header is damaged")
                if kind == _CONTINUED:
                    # blocks of modern headers begin with a signature and end with a checksum
                    todo.append((_uint(data, 0) + 4, _uint(data, 8) - 8) if modern else (_uint(data, 0), _uint(data, 8)))
                elif kind:
                    out.append((kind, data))
                at += size + n
        return out

    def links(self, address: int) -> dict[str, int] | None:
        """Hard links of a group; None if the object isn't one.  Other kinds of links are refused."""
        messages = self.messages(address)
        table = next((d for k, d in messages if k == _TABLE), None)
        if table is not None:
            return self._symbols(_uint(table, 0), _uint(table, 8))
        dense = next((d for k, d in messages if k == _LINKS), None)
        if dense is None:
            return None
        if _uint(dense, 2 + (8 if dense[1] & 1 else 0)) != _NOWHERE:
            raise IoError("groups with links in a heap aren't read")
        out = {}
        for data in (d for k, d in messages if k == _LINK):
            flags, at = data[1], 2
            kind = data[at] if flags & 8 else 0
            at += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
            wide = 1 << (flags & 3)
            n = _uint(data, at, wide)
            name = data[at + wide : at + wide + n].decode()
            if kind:
                raise IoError(f"the link {name!r} isn't a hard one")
            out[name] = _uint(data, at + wide + n)
        return out

    def _symbols(self, tree: int, heap: int) -> dict[str, int]:
        head = self.at(heap, 32)
        if head[:4] != b"HEAP":
            raise IoError("a group has no heap of names")
        names = self.at(_uint(head, 24), _uint(head, 8))
        out: dict[str, int] = {}
        for node in self.leaves(tree, 0, 8):
            data = self.at(node, 8)
            if data[:4] != b"SNOD":
                raise IoError("a group's table is damaged")
            count = _uint(data, 6, 2)
            data = self.at(node, 8 + 40 * count)
            for k in range(count):
                at = 8 + 40 * k
                start = _uint(data, at)
                name = names[start : names.index(b"\0", start)].decode()
                if _uint(data, at + 16, 4) == 2:
                    raise IoError(f"the link {name!r} isn't a hard one")
                out[name] = _uint(data, at + 8)
                if len(out) > MAX_DATASETS:
                    raise IoError("a group holds too many objects")
        return out

    def node(self, address: int, kind: int, key: int) -> tuple[int, list[tuple[bytes, int]]]:
        """Level, and (key, child) of a node of a B-tree of version 1."""
        head = self.at(address, 24)
        if head[:4] != b"TREE" or head[4] != kind:
            raise IoError("a B-tree is damaged")
        n = _uint(head, 6, 2)
        data = self.at(address + 24, n * (key + 8))
        return head[5], [(data[k * (key + 8) : k * (key + 8) + key], _uint(data, k * (key + 8) + key)) for k in range(n)]

    def leaves(self, address: int, kind: int, key: int, nodes: bool = False) -> Iterator[int]:
        """Children of the leaf nodes of a B-tree in order, or these ``nodes`` themselves."""
        todo, seen = [(address, None)], set()
        while todo:
            at, above = todo.pop()
            if at in seen:
                raise IoError("a B-tree leads back to itself")
            seen.add(at)
            level, children = self.node(at, kind, key)
            if above is not None and level != above - 1:
                raise IoError("a B-tree is damaged")
            if level:
                todo += [(child, level) for _, child in reversed(children)]
            elif nodes:
                yield at
            else:
                yield from (child for _, child in children)

    def attributes(self, messages: list[tuple[int, bytes]]) -> dict[str, list[int]]:
        """Attributes of unsigned numbers; others are passed over."""
        out = {}
        for data in (d for k, d in messages if k == _ATTRIBUTE):
            version, sizes = data[0], [_uint(data, 2 + 2 * k, 2) for k in range(3)]
            if version not in (1, 2, 3):
                raise IoError(f"attributes of version {version} aren't read")
            at, parts = 9 if version == 3 else 8, []
            for n in sizes:
                parts.append(data[at : at + n])
                at += _padded(n) if version == 1 else n
            kind, size, big = ("", 0, False) if parts[1][0] & 15 else _element(parts[1])
            if kind in ("i", "u"):
                count = math.prod(_dims(parts[2]))
                values = np.frombuffer(data, np.dtype(f"{'>' if big else '<'}u{size}"), count, at) if at + count * size <= len(data) else None
                if values is None:
                    raise IoError("an attribute is damaged")
                out[parts[0].split(b"\0")[0].decode()] = [int(x) for x in values]
        return out

    def stored(self, messages: list[tuple[int, bytes]], dtype: str) -> Stored:
        """Where a dataset of the type that its attributes name has its cells."""
        found = {k: next((d for kind, d in messages if kind == k), None) for k in (_SPACE, _TYPE, _LAYOUT, _FILTERS)}
        if any(found[k] is None for k in (_SPACE, _TYPE, _LAYOUT)):
            raise IoError("the object is no dataset")
        dims = _dims(found[_SPACE])
        kind, size, big = _element(found[_TYPE])
        if (kind, size) != (dtype[0], Scalar(dtype).width):
            raise IoError(f"the dataset's elements aren't {dtype}")
        layout = found[_LAYOUT]
        if layout[0] != 3:
            raise IoError(f"layouts of version {layout[0]} aren't read")
        if layout[1] == 1:
            return Stored(dims, dtype, big, self.base + _uint(layout, 2), _uint(layout, 10))
        if layout[1] != 2:
            raise IoError("compact datasets aren't read")
        rank = layout[2]
        chunk = tuple(_uint(layout, 11 + 4 * k, 4) for k in range(rank))
        if rank != len(dims) + 1 or chunk[-1] != size or 0 in chunk:
            raise IoError("a chunked dataset is damaged")
        return Stored(dims, dtype, big, _uint(layout, 3), 0, chunk[:-1], self._filters(found[_FILTERS]))

    def _filters(self, data: bytes | None) -> tuple[int, ...]:
        if data is None:
            return ()
        version, n = data[0], data[1]
        at, out = 8 if version == 1 else 2, []
        for _ in range(n):
            kind = _uint(data, at, 2)
            named = version == 1 or kind >= 256
            name = _uint(data, at + 2, 2) if named else 0
            at += 4 if named else 2
            values = _uint(data, at + 2, 2)
            at += 4 + (_padded(name) if version == 1 else name) + 4 * values + (4 if version == 1 and values % 2 else 0)
            if kind not in (_DEFLATE, _SHUFFLE):
                raise IoError(f"the filter {kind} isn't read")
            out.append(kind)
        return tuple(out)


def _info(h5: H5File, address: int, name: str | None) -> tuple[DatasetInfo, Stored]:
    """What a dataset's attributes say, checked against its place in the file."""
    messages = h5.messages(address)
    found = {k.removeprefix(ATTRIBUTE): v for k, v in h5.attributes(messages).items() if k.startswith(ATTRIBUTE)}
    one = {k: found[k][0] if len(found.get(k, [])) == 1 else None for k in ("version", "commit", "n", "type", "width", "extra_rank")}
    if None in one.values() or one["version"] != VERSION:
        raise IoError("a dataset's attributes are missing or of another version")
    if one["commit"] == INCOMPLETE:
        raise IoError(f"{h5.path} was never committed")
    n, e = one["n"], one["extra_rank"]
    if one["commit"] != COMMIT or not 1 <= n or n + e > MAX_RANK:
        raise IoError("a dataset's attributes are damaged")
    scalar = Scalar.from_code(one["type"], one["width"])
    shape, extra, grid, order = (tuple(found.get(k, [])) for k in ("global_shape", "extra_shape", "writer_grid", "writer_permutation"))
    if len(shape) != n or len(extra) != e or 0 in shape or len(grid) > n or 0 in grid or sorted(order) != list(range(n)):
        raise IoError("a dataset's attributes are damaged")
    stored = h5.stored(messages, scalar.name)
    if stored.dims != (*extra, *shape):
        raise IoError("a dataset's extents aren't those of its attributes")
    return DatasetInfo(name, scalar.name, shape, extra, files._words(*grid, *order), stored.address, math.prod(stored.dims) * scalar.width), stored


def _decoded_name(link: str) -> str:
    try:
        raw = bytes.fromhex(link)
        if raw.hex() != link or not raw or len(raw) > MAX_NAME or b"\0" in raw:
            raise ValueError
        return raw.decode()
    except ValueError:
        raise IoError(f"the link {link!r} names no dataset") from None


def datasets(path: str) -> Iterator[tuple[DatasetInfo, Stored]]:
    """All arrays of a file; each object may be reached once, by hard links alone."""
    h5 = H5File(path)
    top = h5.links(h5.root) or {}
    groups = [g for g in (SINGLE, NAMED, TREE) if g in top]
    if not groups:
        raise IoError(f"{path} holds no arrays")
    seen, count = {h5.root}, 0

    def once(address: int) -> int:
        nonlocal count
        if address in seen:
            raise IoError("an object is linked twice")
        seen.add(address)
        count += 1
        if count > MAX_DATASETS:
            raise IoError(f"{path} holds too many objects")
        return address

    for group in groups:
        links = h5.links(once(top[group]))
        if not links or group == SINGLE and set(links) != {DATA}:
            raise IoError(f"the group {group} isn't one of arrays")
        # (name so far, links still to follow), depth first
        todo = [((), iter(sorted(links.items())))]
        while todo:
            above, rest = todo[-1]
            link, address = next(rest, (None, None))
            if link is None:
                todo.pop()
                continue
            inner = h5.links(once(address))
            name = None if group == SINGLE else (*above, _decoded_name(link))
            if inner is None:
                yield _info(h5, address, None if name is None else "/".join(name))
            elif group != TREE or len(todo) >= MAX_DEPTH:
                raise IoError(f"the link {link!r} leads to a group")
            else:
                todo.append((name, iter(sorted(inner.items()))))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """name (null for a single array), dtype, global_shape, extra_shape and provenance of each array of a file."""
    try:
        return files.catalog_frame(spark, [info for info, _ in datasets(path)])
    except (IoError, UnicodeDecodeError) as e:
        raise CatalogError(str(e)) from None


def read(spark: SparkSession, path: str, layout: Layout, extra: Sequence[int] = (), dtype: str = "f64", name: str | None = None) -> NDArray:
    """The single array, or the one called ``name``, under any layout of the stored shape and type."""
    found = next(((info, stored) for info, stored in datasets(path) if info.name == name), None)
    if found is None:
        raise IoError(f"{path} has no dataset {name!r}")
    info, stored = found
    info.check(layout, tuple(extra), dtype)
    if stored.chunk is None:
        return files.cells(spark, path, stored.address, layout, extra, dtype, stored.big_endian)
    return _chunked(spark, path, stored, layout, tuple(extra))


def _unfiltered(data: bytes, stored: Stored, mask: int) -> bytes:
    width = Scalar(stored.dtype).width
    for at, kind in reversed(list(enumerate(stored.filters))):
        if mask >> at & 1:
            continue
        if kind == _DEFLATE:
            data = zlib.decompress(data)
        else:
            data = np.frombuffer(data, np.uint8).reshape(width, -1).T.tobytes()
    if len(data) != math.prod(stored.chunk) * width:
        raise IoError("IoError: a chunk is damaged")
    return data


def _chunked(spark: SparkSession, path: str, stored: Stored, layout: Layout, extra: tuple[int, ...]) -> NDArray:
    ship(spark)
    h5 = H5File(path)
    dims, scalar, key = stored.dims, Scalar(stored.dtype), 8 + 8 * (len(stored.dims) + 1)
    nodes = [] if stored.address == _NOWHERE else list(h5.leaves(stored.address, 1, key, nodes=True))
    names = [*(f"x{k}" for k in range(len(extra))), *(f"i{k}" for k in range(len(layout.shape)))]
    values = ["re", "im"] if stored.dtype.startswith("c") else ["v"]
    kinds = {"float": pa.float32(), "double": pa.float64(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "decimal(20,0)": pa.decimal128(20, 0)}
    arrow = kinds[DTYPES[stored.dtype]]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = H5File(path)
        for address in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
            for head, child in file.node(address, 1, key)[1]:
                size, mask = _uint(head, 0, 4), _uint(head, 4, 4)
                origin = [_uint(head, 8 + 8 * k) for k in range(len(dims))]
                columns = scalar.decode(_unfiltered(file.at(child, size), stored, mask), stored.big_endian)
                # cells of a chunk at the edge that lie outside the array are left out
                keep = tuple(slice(0, max(0, min(c, n - o))) for c, n, o in zip(stored.chunk, dims, origin, strict=True))
                extent = [s.stop for s in keep]
                out = [pa.array(i.ravel() + o) for i, o in zip(np.indices(extent), origin, strict=True)]
                for c in columns:
                    v = np.ascontiguousarray(c.reshape(stored.chunk)[keep]).ravel()
                    out.append(pa.array([Decimal(int(x)) for x in v], arrow) if stored.dtype == "u64" else pa.array(v).cast(arrow))
                yield pa.RecordBatch.from_arrays(out, [*names, *values])

    schema = ", ".join([*(f"{c} long" for c in names), *(f"{v} {DTYPES[stored.dtype]}" for v in values)])
    leaves = spark.createDataFrame([(n,) for n in nodes], "node long").repartition(max(1, min(files.MOST_RANGES, len(nodes))))
    # a chunk that was never written is a hole
    return NDArray.from_dense(leaves.mapInArrow(chunks, schema), layout, extra, stored.dtype)
