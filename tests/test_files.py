import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.errors import IoError
from weftspark.operators.array import NDArray
from weftspark.plans.layout import Layout
from weftspark.sources import files, parquet
from weftspark.sources.codec import TYPES, Scalar


def cells(spark, layout, extra=(), dtype="i32"):
    return NDArray.from_fn(spark, layout, lambda c: sum((c[k] * w for k, w in zip(sorted(c, reverse=True), (1000, 100, 1))), F.lit(0)), extra, dtype)


def rows(a):
    return sorted(tuple(r) for r in a.table().collect())


@pytest.mark.parametrize("name", [t for t in TYPES if not t.startswith("c")])
def test_codec_keeps_bits(name):
    kind = np.dtype(TYPES[name][2])
    raw = np.random.default_rng(1).integers(0, 256, 16 * kind.itemsize, dtype=np.uint8).tobytes()
    assert Scalar(name).encode(Scalar(name).decode(raw)) == raw
    assert Scalar.from_code(Scalar(name).code, Scalar(name).width).name == name


def test_complex_codec_swaps_parts_alone():
    raw = np.array([1.5, -2.5, 3.0, 4.0], ">f8").tobytes()
    assert [c.tolist() for c in Scalar("c128").decode(raw, big_endian=True)] == [[1.5, 3.0], [-2.5, 4.0]]


@pytest.mark.parametrize("dtype", ["i8", "u16", "i64", "u64", "f32", "f64"])
def test_any_layout_reads_what_another_wrote(spark, tmp_path, dtype):
    written = cells(spark, Layout.of((4, 5), (2,), permutation=(1, 0)), (2,), "i64")
    written = written.with_df(written.df.withColumn("v", (F.col("v") % 100).cast({"i8": "tinyint", "u16": "int", "i64": "bigint", "u64": "decimal(20,0)", "f32": "float", "f64": "double"}[dtype])), dtype=dtype)
    path = str(tmp_path / "a")
    files.write_array(path, written)
    read = files.read_array(spark, path, Layout.of((4, 5), (1, 3)), (2,), dtype)
    assert rows(read) == rows(written)
    assert files.catalog(spark, path).first()["global_shape"] == [4, 5]
    with pytest.raises(IoError):
        files.write_array(path, written)
    with pytest.raises(IoError):
        files.read_array(spark, path, Layout.of((5, 4)), (2,), dtype)


def test_header_words(spark, tmp_path):
    path = str(tmp_path / "a")
    files.write_array(path, cells(spark, Layout.of((2, 3), permutation=(1, 0))))
    words = np.frombuffer(open(path, "rb").read()[8:136], "<u8").tolist()
    assert words[:11] == [1, 136, files.COMMIT, 2, 5, 4, 0, 136, 24, 1, 0]
    assert words[11:] == [2, 3, 1, 1, 0]


@pytest.mark.parametrize("at", [0, 8, 16, 24, 32, 40, 64, 72, 88, 96, 128])
def test_damage_is_refused(spark, tmp_path, at):
    path = str(tmp_path / "a")
    files.write_array(path, cells(spark, Layout.of((2, 3))))
    with open(path, "r+b") as f:
        f.seek(at)
        f.write(b"\x77")
    with pytest.raises(IoError):
        files.read_array(spark, path, Layout.of((2, 3)), (), "i32")


def test_unfinished_and_cut_files_are_refused(spark, tmp_path):
    a = cells(spark, Layout.of((2, 3)))
    holed = a.with_df(a.df.filter("not (i0 = 1 and i1 = 1)"))
    with pytest.raises(IoError):
        files.write_array(str(tmp_path / "a"), holed)
    with pytest.raises(IoError, match="committed"):
        files.describe(str(tmp_path / "a"))
    files.write_array(str(tmp_path / "b"), a)
    os.truncate(tmp_path / "b", os.path.getsize(tmp_path / "b") - 1)
    with pytest.raises(IoError):
        files.describe(str(tmp_path / "b"))


def test_raw(spark, tmp_path):
    path = tmp_path / "raw"
    path.write_bytes(b"xyz" + np.arange(6, dtype=">i2").tobytes() + b"tail")
    a = files.read_raw(spark, str(path), Layout.of((2, 3)), (), "i16", 3, "big")
    assert [r["v"] for r in a.gather().collect()] == list(range(6))


def test_named_container(spark, tmp_path):
    path, layout = str(tmp_path / "n"), Layout.of((2, 3))
    a = cells(spark, layout)
    with files.FileSession(spark, path, "create") as s:
        s.write("one", a)
        s.write("zwei/ü", a.with_df(a.df.withColumn("v", F.col("v") + 1)))
        with pytest.raises(IoError):
            s.write("one", a)
    assert [r["name"] for r in files.named_catalog(spark, path).collect()] == ["one", "zwei/ü"]
    assert rows(files.read_named(spark, path, "one", layout, (), "i32")) == rows(a)
    with pytest.raises(IoError):
        files.append_named(path, "a\0b", a)
    with open(path, "ab") as f:
        f.write(b"half a record")
    with pytest.raises(IoError):
        files.append_named(path, "three", a)
    assert rows(files.read_named(spark, path, "one", layout, (), "i32")) == rows(a)


@pytest.mark.parametrize("grid, axes, permutation", [((1,), (0,), (0, 1)), ((2, 2), (1, 0), (1, 0)), ((2, 3), (0, 1), (1, 0))])
def test_blocks(spark, tmp_path, grid, axes, permutation):
    layout = Layout.of((3, 5), grid, axes, permutation)
    a = cells(spark, layout, (2,))
    path = str(tmp_path / "c")
    files.write_chunked(path, a)
    assert rows(files.read_chunked(spark, path, layout, (2,), "i32")) == rows(a)
    assert files.chunked_catalog(spark, path).first()["extra_shape"] == [2]
    with pytest.raises(IoError):
        files.read_chunked(spark, path, layout.with_permutation(tuple(reversed(permutation))), (2,), "i32")


def test_collections(spark, tmp_path):
    layout = Layout.of((2, 3))
    a = cells(spark, layout)
    b = a.with_df(a.df.withColumn("v", -F.col("v")))
    files.write_collection(str(tmp_path / "m"), [a, b])
    got = files.read_collection(spark, str(tmp_path / "m"), 2, layout, (), "i32")
    assert [rows(x) for x in got] == [rows(a), rows(b)]
    with pytest.raises(IoError):
        files.write_collection(str(tmp_path / "e"), [])


def test_parquet_store(spark, tmp_path):
    store = parquet.Store(spark, f"file://{tmp_path}/store")
    a = cells(spark, Layout.of((2, 3), permutation=(1, 0)), (2,))
    store.write("a/b", a)
    assert store.names() == ["a/b"] and rows(store.read("a/b")) == rows(a) and store.read("a/b").layout == a.layout
    with pytest.raises(IoError):
        store.write("a/b", a)
    with pytest.raises(IoError):
        store.read("none")
    assert store.catalog().first()["dtype"] == "i32"
    b = a.with_df(a.df.withColumn("v", F.col("v") + 1))
    store.write_collection("both", [a, b], parquet.Options("gzip", 1 << 20, 2))
    assert [rows(x) for x in store.read_collection("both")] == [rows(a), rows(b)]
    with pytest.raises(IoError):
        store.write_collection("none", [])
    with pytest.raises(IoError):
        parquet.Options("zip")


def test_parquet_tree(spark, tmp_path):
    path = f"file://{tmp_path}/tree"
    a = cells(spark, Layout.of((2, 3)))
    with parquet.TreeSession(spark, path, "create") as t:
        t.create_group("run")
        t.create_group("run/ü")
        t.write("run/ü/x", a)
        t.write("top", a)
        for bad in ("run", "top", "none/x", "a//b", "/".join("a" * 40)):
            with pytest.raises(IoError):
                t.write(bad, a)
    with pytest.raises(IoError):
        t.read("top")
    with parquet.TreeSession(spark, path, "read") as t:
        assert [r["name"] for r in t.catalog().collect()] == ["run/ü/x", "top"] and rows(t.read("run/ü/x")) == rows(a)
        with pytest.raises(IoError):
            t.create_group("more")
    with pytest.raises(IoError):
        parquet.TreeSession(spark, path, "create")


@pytest.mark.parametrize("piece", [1, 4, 7])
def test_ranges_of_any_size(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(files, "PIECE", piece)
    layout = Layout.of((3, 5), (2, 2), (1, 0), (1, 0))
    a = cells(spark, layout, (2,))
    files.write_array(str(tmp_path / "a"), a)
    files.write_chunked(str(tmp_path / "c"), a, files.WriteOptions("independent", (("striping_factor", "4"),)))
    files.write_raw(str(tmp_path / "r"), a, head=b"head")
    assert rows(files.read_array(spark, str(tmp_path / "a"), layout, (2,), "i32")) == rows(a) == rows(files.read_chunked(spark, str(tmp_path / "c"), layout, (2,), "i32"))
    assert rows(files.read_raw(spark, str(tmp_path / "r"), layout, (2,), "i32", 4)) == rows(a)
    files.write_collection(str(tmp_path / "m"), [a, a.with_df(a.df.withColumn("v", -F.col("v")))])
    assert [v for *_, v in rows(files.read_collection(spark, str(tmp_path / "m"), 2, layout, (2,), "i32")[1])] == [-v for *_, v in rows(a)]
    for bad in (a.with_df(a.df.filter("v > 0")), a.with_df(a.df.union(a.df.limit(1))), a.with_df(a.df.withColumn("i0", F.lit(0).cast("long")))):
        with pytest.raises(IoError):
            files.write_array(str(tmp_path / f"bad{id(bad)}"), bad)


def test_more_blocks_than_cells(spark, tmp_path):
    layout = Layout.of((2, 3), (3, 4))
    a = cells(spark, layout)
    files.write_chunked(str(tmp_path / "c"), a)
    assert rows(files.read_chunked(spark, str(tmp_path / "c"), layout, (), "i32")) == rows(a)


def test_transfer_options():
    for bad in (("all", ()), ("collective", (("", "x"),)), ("collective", (("k", "a\0"),))):
        with pytest.raises(IoError):
            files.WriteOptions(*bad)


def test_parquet_files_are_in_order(spark, tmp_path):
    a = cells(spark, Layout.of((6, 7)), (2,))
    parquet.write(a, str(tmp_path / "p"), parquet.Options(partitions=5))
    parts = sorted(p for p in (tmp_path / "p").iterdir() if p.suffix == ".parquet")
    seen = [(r["x0"], r["i0"], r["i1"]) for p in parts for r in spark.read.parquet(str(p)).collect()]
    assert len(parts) == 5 and seen == sorted(seen) and len(seen) == 84
    assert rows(parquet.read(spark, str(tmp_path / "p"))) == rows(a)
