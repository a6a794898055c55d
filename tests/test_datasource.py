"""Array files as a data source that reads slices."""

import io
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.errors import IoError
from weftspark.operators.array import NDArray
from weftspark.plans.layout import Layout
from weftspark.sources import datasource, files
from weftspark.sources.datasource import ArrayReader, Box, Place


def stored(spark, path, dtype="f64", extra=(2,)):
    a = NDArray.from_fn(spark, Layout.of((5, 6, 7)), lambda c: (c["x0"] * 210 + c["i0"] * 42 + c["i1"] * 7 + c["i2"]) % 100, extra, dtype)
    files.write_array(str(path), a)
    return a


def rows(df):
    return sorted(tuple(r) for r in df.collect())


SLICES = [
    ({"i0": 2}, "i0 = 2"),
    ({"i0": 2, "i1": (3, 5)}, "i0 = 2 and i1 >= 3 and i1 < 5"),
    ({"x0": 1, "i2": (None, 5)}, "x0 = 1 and i2 <= 4"),
    ({"i0": (4, None)}, "i0 >= 4"),
    ({"i1": 9}, "false"),
    ({"i1": -1}, "false"),
    ({"i2": (5, 2)}, "false"),
    ({"x0": (0, 99), "i2": 6}, "i2 = 6"),
    ({}, "true"),
]


@pytest.mark.parametrize("where, same", SLICES)
def test_slices_are_the_cells_within_bounds(spark, tmp_path, where, same):
    a = stored(spark, tmp_path / "a")
    b = datasource.scan(spark, str(tmp_path / "a"), where=where)
    assert b.shape == a.shape and b.extra == a.extra and rows(b.df) == rows(a.table().filter(same))
    assert rows(b.df.filter("i0 in (1, 2) and v > 20").select("v", "i1")) == rows(a.df.filter(f"({same}) and i0 in (1, 2) and v > 20").select("v", "i1"))


def test_one_table_serves_many_queries(spark, tmp_path):
    stored(spark, tmp_path / "a")
    df = datasource.scan(spark, str(tmp_path / "a")).df
    assert [df.filter(f"i0 = {k}").count() for k in range(3)] == [84, 84, 84] and df.count() == 420
    assert df.filter("i0 = 2").union(df.filter("i0 = 4")).groupBy("i0").count().count() == 2


@pytest.mark.parametrize("dtype", ["i8", "u16", "i64", "u64", "f32"])
def test_types_names_and_raw_files(spark, tmp_path, dtype):
    a = stored(spark, tmp_path / "a", dtype)
    files.write_named(str(tmp_path / "n"), "größe", a)
    files.write_raw(str(tmp_path / "r"), a, b"head!")
    raw = {"shape": "5,6,7", "extra": "2", "dtype": dtype, "byteOffset": 5, "byteOrder": "little"}
    for b in (datasource.scan(spark, str(tmp_path / "a")), datasource.scan(spark, str(tmp_path / "n"), "größe"), datasource.scan(spark, str(tmp_path / "r"), **raw)):
        assert b.dtype == dtype and rows(b.df) == rows(a.table())
    for bad in ({"path": str(tmp_path / "r")}, {"path": str(tmp_path / "n"), "dataset": "x"}, {"path": str(tmp_path / "r"), "shape": "500", "dtype": dtype}, {}):
        with pytest.raises(IoError):
            Place.of(bad)


def test_only_the_ranges_of_a_slice_are_read(spark, tmp_path):
    a = stored(spark, tmp_path / "a")
    place = Place.of({"path": str(tmp_path / "a")})
    reader = ArrayReader(place, {"i0": "2"})
    assert reader.ranges() == [(place.start + 8 * (2 * 42 + x * 210), 8 * 42) for x in (0, 1)]
    assert sum(n for _, n in ArrayReader(place, {"x0": "1", "i0": "2", "i1": "1:3"}).ranges()) == 8 * 14
    # a file in which all else is gone gives the slice, and nothing else
    raw = bytearray((tmp_path / "a").read_bytes())
    keep = set(itertools.chain.from_iterable(range(at, at + n) for at, n in reader.ranges()))
    for i in range(place.start, len(raw)):
        if i not in keep:
            raw[i] = 255
    (tmp_path / "b").write_bytes(bytes(raw))
    assert rows(datasource.scan(spark, str(tmp_path / "b"), where={"i0": 2}).df) == rows(a.table().filter("i0 = 2"))
    assert datasource.scan(spark, str(tmp_path / "b")).df.filter(F.isnan("v")).count() == 420 - 84
    for bad in ({"i0": "two"}, {"i1": "1:x"}):
        with pytest.raises(IoError):
            ArrayReader(place, bad)
    with pytest.raises(IoError):
        datasource.scan(spark, str(tmp_path / "a"), where={"i9": 1})


def test_bounds_of_any_box(monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(60):
        dims = tuple(int(x) for x in rng.integers(1, 5, rng.integers(1, 5)))
        low = tuple(int(rng.integers(0, n)) for n in dims)
        high = tuple(int(rng.integers(a, n + 1)) for a, n in zip(low, dims, strict=True))
        box, x = Box(dims, low, high), np.arange(np.prod(dims)).reshape(dims)
        want = x[tuple(slice(a, b) for a, b in zip(low, high, strict=True))].ravel()
        cuts = sorted({0, box.cells, *rng.integers(0, box.cells + 1, 2).tolist()})
        got = [i for a, b in itertools.pairwise(cuts) for at, n in box.ranges(a, b) for i in range(at, at + n)]
        assert got == want.tolist()
        if box.cells:
            assert (np.ravel_multi_index(box.coordinates(0, box.cells), dims) == want).all()


class Counted(io.BytesIO):
    """A file that knows how often it is read."""

    reads = 0

    def read_at(self, n, at):
        self.reads += 1
        return self.getvalue()[at : at + n]


def test_runs_that_lie_close_are_one_read():
    x = np.arange(7 + 400 * 30 * 2, dtype="<f8")
    box = Box((400, 30, 2), (3, 4, 1), (390, 9, 2))
    f = Counted(x.tobytes())
    for a, b in itertools.pairwise([0, 1, 777, 778, box.cells]):
        got = np.frombuffer(datasource.read_runs(f, 7 * 8, 8, *box.runs(a, b)))
        assert (got == 7 + np.ravel_multi_index(box.coordinates(a, b), box.dims)).all() and len(got) == b - a
    assert f.reads == 4


@pytest.mark.parametrize("gap, window", [(0, 64), (100, 64), (100, 1 << 20), (4096, 1 << 20)])
def test_runs_of_any_box_are_read(monkeypatch, gap, window):
    monkeypatch.setattr(datasource, "GAP", gap)
    monkeypatch.setattr(datasource, "READ", window)
    rng = np.random.default_rng(gap + window)
    for _ in range(60):
        dims = tuple(int(x) for x in rng.integers(1, 7, rng.integers(1, 5)))
        low = tuple(int(rng.integers(0, n)) for n in dims)
        high = tuple(int(rng.integers(a, n + 1)) for a, n in zip(low, dims, strict=True))
        box, x = Box(dims, low, high), np.arange(np.prod(dims), dtype="<f8").reshape(dims)
        want = x[tuple(slice(a, b) for a, b in zip(low, high, strict=True))].ravel()
        cuts = sorted({0, box.cells, *rng.integers(0, box.cells + 1, 2).tolist()})
        f = Counted(b"head" + x.tobytes())
        got = b"".join(datasource.read_runs(f, 4, 8, *box.runs(a, b)) for a, b in itertools.pairwise(cuts))
        assert (np.frombuffer(got) == want).all() and box.runs(box.cells, box.cells)[0].size == 0


def test_partitions_are_spans(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 50)
    stored(spark, tmp_path / "a")
    reader = ArrayReader(Place.of({"path": str(tmp_path / "a")}), {"i0": "1:4", "i1": "2:5", "x0": "1"})
    assert [(p.first, p.last) for p in reader.partitions()] == [(0, 50), (50, 63)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 63
