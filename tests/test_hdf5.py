"""HDF5 files that a small encoder of the tests writes."""

import struct
import zlib

import numpy as np
import pytest

from weftspark.errors import ArrayError, CatalogError, IoError
from weftspark.plans.layout import Layout
from weftspark.sources import hdf5
from weftspark.sources.codec import Scalar
from weftspark.sources.files import COMMIT, INCOMPLETE

NOWHERE = b"\xff" * 8


def u(*values, size=8):
    return b"".join(int(v).to_bytes(size, "little") for v in values)


def pad(data):
    return data + b"\0" * (-len(data) % 8)


class Encoder:
    """Superblock 0, object headers 1, symbol tables and B-trees of version 1."""

    def __init__(self):
        self.data = bytearray(96)

    def put(self, data):
        at = len(self.data)
        self.data += pad(data)
        return at

    def header(self, messages, split=False):
        """An object header; with ``split`` its later messages are in a continuation."""
        raw = [u(kind, len(pad(body)), size=2) + b"\0" * 4 + pad(body) for kind, body in messages]
        if split and len(raw) > 2:
            rest = b"".join(raw[2:])
            at = self.put(rest)
            raw = [*raw[:2], u(16, 16, size=2) + b"\0" * 4 + u(at, len(rest))]
        block = b"".join(raw)
        return self.put(b"\1\0" + u(len(raw), size=2) + u(1, len(block), size=4) + b"\0" * 4 + block)

    def group(self, links, kinds=None):
        """A symbol table of several nodes under a root node of one or two levels."""
        names = sorted(links)
        heap, places = bytearray(8), {}
        for name in names:
            places[name] = len(heap)
            heap += pad(name.encode() + b"\0")
        body = self.put(bytes(heap))
        top = self.put(b"HEAP" + b"\0" * 4 + u(len(heap), 0, body))
        nodes = []
        for k in range(0, len(names), 3):
            some = names[k : k + 3]
            entries = b"".join(u(places[n], links[n]) + u((kinds or {}).get(n, 0), 0, size=4) + b"\0" * 16 for n in some)
            nodes.append(self.put(b"SNOD\1\0" + u(len(some), size=2) + entries))
        tree = self.tree(0, [(u(0), n) for n in nodes])
        return self.header([(17, u(tree, top))])

    def tree(self, kind, children, fan=2):
        level = 0
        while True:
            above = []
            for k in range(0, max(1, len(children)), fan):
                some = children[k : k + fan]
                body = b"TREE" + bytes([kind, level]) + u(len(some), size=2) + NOWHERE * 2 + b"".join(key + u(child) for key, child in some) + (some[-1][0] if some else u(0))
                above.append((some[0][0] if some else u(0), self.put(body)))
            if len(above) == 1:
                return above[0][1]
            children, level = above, level + 1

    def attribute(self, name, values, version=1):
        kind = b"\x10\0\0\0" + u(8, size=4) + u(0, 64, size=2)
        space = b"\1\1\0\0\0\0\0\0" + u(len(values))
        label = name.encode() + b"\0"
        sizes = u(len(label), len(kind), len(space), size=2)
        if version == 1:
            return 12, b"\1\0" + sizes + pad(label) + pad(kind) + pad(space) + u(*values)
        return 12, b"\3\0" + sizes + b"\0" + label + kind + space + u(*values)

    def kind(self, dtype, big=False):
        size = Scalar(dtype).width
        if dtype[0] in "iu":
            return bytes([0x10, (8 if dtype[0] == "i" else 0) | big, 0, 0]) + u(size, size=4) + u(0, 8 * size, size=2)
        single = lambda n: bytes([0x11, 0x20 | big, 8 * n - 1, 0]) + u(n, size=4) + b"\0" * 12
        if dtype[0] == "f":
            return single(size)
        half = size // 2
        member = lambda name, at: pad(name + b"\0") + u(at, size=4) + b"\0" * 28 + single(half)
        return bytes([0x16, 2, 0, 0]) + u(size, size=4) + member(b"r", 0) + member(b"i", half)

    def dataset(self, x, dtype, extra=0, chunk=None, filters=(), commit=COMMIT, big=False, split=False, version=1, holes=(), code=None):
        scalar, dims = Scalar(dtype), x.shape
        stored = x.astype(x.dtype.newbyteorder(">" if big else "<"))
        n = len(dims) - extra
        messages = [(1, b"\1" + bytes([len(dims)]) + b"\0" * 6 + u(*dims)), (3, self.kind(dtype, big))]
        if chunk is None:
            messages.append((8, b"\3\1" + u(self.put(stored.tobytes()), stored.nbytes)))
        else:
            children = []
            for i, origin in enumerate(np.ndindex(*[-(-d // c) for d, c in zip(dims, chunk, strict=True)])):
                at = [o * c for o, c in zip(origin, chunk, strict=True)]
                block = np.zeros(chunk, stored.dtype)
                part = stored[tuple(slice(o, o + c) for o, c in zip(at, chunk, strict=True))]
                block[tuple(slice(0, s) for s in part.shape)] = part
                raw, mask = block.tobytes(), 0
                for k, f in enumerate(filters):
                    if f == 1 and i % 3 == 2:
                        mask |= 1 << k  # a chunk that its filter passed over
                    elif f == 1:
                        raw = zlib.compress(raw)
                    else:
                        raw = np.frombuffer(raw, np.uint8).reshape(-1, scalar.width).T.tobytes()
                if i not in holes:
                    children.append((u(len(raw), mask, size=4) + u(*at, 0), self.put(raw)))
            messages.append((8, b"\3\2" + bytes([len(dims) + 1]) + u(self.tree(1, children)) + u(*chunk, scalar.width, size=4)))
            if filters:
                body = b"\1" + bytes([len(filters)]) + b"\0" * 6
                for f in filters:
                    name = pad(b"deflate\0" if f == 1 else b"shuffle\0")
                    body += u(f, len(name), 1, 1, size=2) + name + u(4, 0, size=4)
                messages.append((11, body))
        code = Scalar(dtype).code if code is None else code
        values = {"version": [1], "commit": [commit], "n": [n], "type": [code], "width": [scalar.width], "extra_rank": [extra], "global_shape": dims[extra:], "writer_grid": [1], "writer_permutation": range(n)}
        if extra:
            values["extra_shape"] = dims[:extra]
        messages += [self.attribute(hdf5.ATTRIBUTE + k, list(v), version) for k, v in values.items()]
        return self.header(messages, split)

    def save(self, path, root, eof=None):
        head = b"\x89HDF\r\n\x1a\n" + b"\0" * 5 + b"\x08\x08\0" + u(4, 16, size=2) + u(0, size=4) + u(0) + NOWHERE + u(len(self.data)) + NOWHERE + u(0, root) + b"\0" * 24
        self.data[: len(head)] = head
        path.write_bytes(bytes(self.data))
        return str(path)


def dump(a):
    rows = a.df.toPandas()
    out = np.full((*a.extra, *a.shape), 0, complex if a.complex else object if a.dtype == "u64" else float)
    assert len(rows) == out.size
    out[tuple(rows[c].to_numpy() for c in a.coords)] = rows.re + 1j * rows.im if a.complex else rows.v
    return out


def values(dtype, *shape):
    rng = np.random.default_rng(len(shape))
    if dtype.startswith("c"):
        return (rng.normal(size=shape) + 1j * rng.normal(size=shape)).astype("c8" if dtype == "c64" else "c16")
    if dtype.startswith("f"):
        return rng.normal(size=shape).astype("f" + str(Scalar(dtype).width))
    return rng.integers(0, 100, shape).astype(f"{dtype[0]}{Scalar(dtype).width}") + (np.uint64(2**63 + 5) if dtype == "u64" else 0)


def single(tmp_path, x, dtype, **how):
    e = Encoder()
    return e.save(tmp_path / "a.h5", e.group({hdf5.SINGLE: e.group({hdf5.DATA: e.dataset(x, dtype, **how)})}))


@pytest.mark.parametrize("dtype", ["i8", "u8", "i16", "u16", "i32", "u32", "i64", "u64", "f32", "f64", "c64", "c128"])
@pytest.mark.parametrize("how", [{}, {"chunk": (2, 3, 4), "filters": (2, 1)}])
def test_every_type(spark, tmp_path, dtype, how):
    x = values(dtype, 2, 5, 7)
    path = single(tmp_path, x, dtype, extra=1, **how)
    assert (dump(hdf5.read(spark, path, Layout.of((5, 7), (2,)), (2,), dtype)) == x).all()
    row = hdf5.catalog(spark, path).first()
    assert (row["name"], row["dtype"], row["global_shape"], row["extra_shape"]) == (None, dtype, [5, 7], [2])


@pytest.mark.parametrize("how", [{"big": True}, {"split": True}, {"version": 3}, {"chunk": (4, 4)}, {"chunk": (1, 1)}, {"chunk": (9, 9), "filters": (1,)}, {"chunk": (3, 2), "filters": (2, 1), "big": True}])
def test_forms_of_a_dataset(spark, tmp_path, how):
    x = values("f64", 8, 9)
    assert (dump(hdf5.read(spark, single(tmp_path, x, "f64", **how), Layout.of((8, 9)))) == x).all()


def test_named_arrays_and_trees(spark, tmp_path):
    e, x, y = Encoder(), values("f64", 3, 4), values("i32", 5)
    hexed = lambda s: s.encode().hex()
    many = {hexed(f"n{i}"): e.dataset(y + i, "i32") for i in range(20)} | {hexed("größe"): e.dataset(x, "f64", chunk=(2, 2))}
    tree = {hexed("run"): e.group({hexed("first"): e.dataset(x, "f64"), hexed("deep"): e.group({hexed("y"): e.dataset(y, "i32")})})}
    path = e.save(tmp_path / "n.h5", e.group({hdf5.NAMED: e.group(many), hdf5.TREE: e.group(tree)}))
    assert {r["name"] for r in hdf5.catalog(spark, path).collect()} == {*(f"n{i}" for i in range(20)), "größe", "run/first", "run/deep/y"}
    assert (dump(hdf5.read(spark, path, Layout.of((3, 4)), name="größe")) == x).all()
    assert (dump(hdf5.read(spark, path, Layout.of((5,)), dtype="i32", name="n7")) == y + 7).all()
    assert (dump(hdf5.read(spark, path, Layout.of((5,)), dtype="i32", name="run/deep/y")) == y).all()
    for name, layout, dtype in (("n99", Layout.of((5,)), "i32"), ("n7", Layout.of((6,)), "i32"), ("n7", Layout.of((5,)), "i64")):
        with pytest.raises(IoError):
            hdf5.read(spark, path, layout, dtype=dtype, name=name)


def test_links_that_are_refused(spark, tmp_path):
    e = Encoder()
    d = e.dataset(values("f64", 3), "f64")
    hexed = "61"
    loop = e.group({hexed: 0})
    again = e.group({hexed: loop})
    tree = int.from_bytes(e.data[loop + 24 : loop + 32], "little")
    node = int.from_bytes(e.data[tree + 32 : tree + 40], "little")
    e.data[node + 16 : node + 24] = u(again)
    deep = d
    for _ in range(hdf5.MAX_DEPTH + 2):
        deep = e.group({hexed: deep})
    for found, message in (
        ({hdf5.NAMED: e.group({hexed: d}, {hexed: 2})}, "hard"),
        ({hdf5.NAMED: e.group({hexed: d, "62": d})}, "twice"),
        ({hdf5.TREE: loop}, "twice"),
        ({hdf5.TREE: deep}, "leads to a group"),
        ({hdf5.NAMED: e.group({hexed: e.group({hexed: d})})}, "leads to a group"),
        ({hdf5.NAMED: e.group({"xyz": d})}, "names no dataset"),
        ({hdf5.SINGLE: e.group({"other": d})}, "isn't one of arrays"),
        ({"somewhere": e.group({hexed: d})}, "no arrays"),
    ):
        path = e.save(tmp_path / "l.h5", e.group(found))
        with pytest.raises(CatalogError, match=message):
            hdf5.catalog(spark, path)


def test_files_that_are_refused(spark, tmp_path):
    x = values("f64", 6, 6)
    paths = [lambda how=how: single(tmp_path, x, "f64", **how) for how in ({"commit": INCOMPLETE}, {"commit": 7}, {"code": 9}, {"code": 99})]
    for path in (*paths, lambda: _other_filter(tmp_path, x)):
        with pytest.raises(CatalogError):
            hdf5.catalog(spark, path())
    single(tmp_path, x, "f64", chunk=(2, 2), filters=(1,))
    raw = (tmp_path / "a.h5").read_bytes()
    for cut in (4, 60, 300):
        (tmp_path / "c.h5").write_bytes(raw[:cut])
        with pytest.raises(CatalogError):
            hdf5.catalog(spark, str(tmp_path / "c.h5"))
    with pytest.raises(ArrayError, match="32 cells for 36"):
        hdf5.read(spark, single(tmp_path, x, "f64", chunk=(2, 2), holes=(4,)), Layout.of((6, 6))).validate_dense()


def _other_filter(tmp_path, x):
    e = Encoder()
    at = e.dataset(x, "f64", chunk=(3, 3), filters=(2,))
    where = e.data.rindex(pad(b"shuffle\0")) - 8
    e.data[where : where + 2] = struct.pack("<H", 32000)
    return e.save(tmp_path / "f.h5", e.group({hdf5.SINGLE: e.group({hdf5.DATA: at})}))
