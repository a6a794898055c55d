"""Arrays as tiles, long lines in several stages, folds in trees, and what Spark measures, against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftspark.errors import ArrayError, InvalidSpectrum, IoError, PointwiseError, ReductionError, TransformError, typed
from weftspark.functions import kernels
from weftspark.operators import array, pointwise, reduce
from weftspark.operators.array import NDArray
from weftspark.operators.tiles import Tiles, Tiling, tiling_for
from weftspark.plans import transforms as T
from weftspark.plans.layout import Layout
from weftspark.plans.measure import measured
from weftspark.plans.stages import Tuning, apply_steps
from weftspark.sources import parquet

STAGES = T.Options(tuning=Tuning(slab_cells=1, small_cells=0))


def signal(*shape, complex_=True):
    rng = np.random.default_rng(sum(shape))
    return rng.normal(size=shape) + (1j * rng.normal(size=shape) if complex_ else 0)


def load(spark, x, batch=0, dtype=None):
    names = [*(f"x{k}" for k in range(batch)), *(f"i{k}" for k in range(x.ndim - batch))]
    columns = dict(zip(names, np.indices(x.shape).reshape(x.ndim, -1), strict=True))
    columns |= {"re": x.real.ravel(), "im": x.imag.ravel()} if np.iscomplexobj(x) else {"v": x.ravel()}
    return NDArray(spark.createDataFrame(pd.DataFrame(columns)), Layout.of(x.shape[batch:]), x.shape[:batch], dtype or ("c128" if np.iscomplexobj(x) else "f64"))


def dump(a):
    a = a.to_cells() if isinstance(a, Tiles) else a
    rows = a.df.toPandas()
    out = np.full((*a.extra, *a.shape), np.nan, complex if a.complex else float)
    assert len(rows) == out.size
    out[tuple(rows[c].to_numpy() for c in a.coords)] = rows.re + 1j * rows.im if a.complex else rows.v
    return out


# tiles


def test_tilings():
    t = Tiling((5, 7), (2, 7))
    assert t.counts == (3, 1) and t.origin(2) == (4, 0) and t.extent((4, 0)) == (1, 7) and t.block((4, 0)) == 2
    assert tiling_for((100, 100, 100), [2], 1000).chunk == (1, 10, 100) and tiling_for((4, 4), [], 100).chunk == (4, 4)
    assert sorted(b for b, _, _ in Tiling((6, 6), (4, 4)).pieces((2, 2), (3, 3))) == [0, 1, 2, 3]


@pytest.mark.parametrize("chunk", [(1, 2, 3, 4), (2, 5, 7, 6), (1, 1, 1, 1), (2, 3, 7, 2)])
def test_tiles_hold_the_cells(spark, chunk):
    x = signal(2, 5, 7, 6)
    t = Tiles.from_cells(load(spark, x, 1), chunk)
    assert t.df.count() == math.prod(t.tiling.counts) and np.array_equal(dump(t), x)
    other = t.retiled(Tiling((2, 5, 7, 6), (2, 4, 2, 3)))
    assert other.df.count() == 1 * 2 * 4 * 2 and np.array_equal(dump(other), x)


@pytest.mark.parametrize("options", [T.Options(), STAGES, T.Options(tuning=Tuning(line_cells=6))])
def test_plans_take_tiles(spark, options):
    x, y = signal(2, 5, 7, 6), signal(5, 7, 6, complex_=False)
    t, r = Tiles.from_cells(load(spark, x, 1), (1, 2, 3, 4)), Tiles.from_cells(load(spark, y), (2, 3, 2))
    plan = T.C2c.like(t, options=options)
    assert np.allclose(dump(plan.forward(t)), np.fft.fftn(x, axes=(1, 2, 3))) and np.allclose(dump(plan.inverse(plan.forward(t))), x)
    half = T.R2c.like(r, [0, 2], options=options)
    assert np.allclose(dump(half.forward(r)), np.fft.fft(np.fft.rfft(y, axis=2), axis=0)) and np.allclose(dump(half.inverse(half.forward(r))), y)
    for real in (T.R2r.like(r, ("dct2", None, "dst1"), options=options), T.Dht.like(r, options=options), T.MixedR2c.like(r, ("fft", "rfft", "dct2"), options=options)):
        assert np.allclose(dump(real.inverse(real.forward(r))), y)


def test_tiles_of_single_precision_and_wrong_spectra(spark):
    x = signal(4, 6, complex_=False)
    t = Tiles.from_cells(load(spark, x, dtype="f32"), (2, 2))
    plan = T.R2c.like(t)
    assert plan.forward(t).dtype == "c64" and np.allclose(dump(plan.forward(t)), np.fft.rfft2(x), atol=1e-4)
    half = T.R2c((4, 6)).forward(load(spark, x))
    wrong = Tiles.from_cells(half.with_df(half.df.withColumn("im", F.when(F.expr("i0 = 1 and i1 = 3"), F.col("im") + 0.01).otherwise(F.col("im")))), (2, 2))
    with pytest.raises(InvalidSpectrum):
        T.R2c((4, 6)).check_spectrum(wrong)
    with pytest.raises(InvalidSpectrum), typed():
        T.R2c((4, 6)).inverse(wrong).df.collect()


def test_tiles_refuse_holes_and_odd_tilings(spark):
    a = load(spark, signal(4, 6, complex_=False))
    for bad in ("i0 = 1 and i1 = 5", "i0 = 0 and i1 = 0"):
        with pytest.raises(TransformError, match="dense"), typed():
            Tiles.from_cells(a.with_df(a.df.filter(f"not ({bad})")), (2, 3)).df.collect()
    t = Tiles.from_cells(a, (2, 3))
    with pytest.raises(TransformError, match="dense"), typed():
        t.with_df(t.df.filter("block_id <> 1")).retiled(Tiling((4, 6), (4, 2))).df.collect()
    with pytest.raises(ArrayError):
        Tiles.from_cells(a, (2,))
    with pytest.raises(PointwiseError):
        t.pointwise(lambda x, y: x + y, Tiles.from_cells(a, (4, 6)))


def test_tiles_are_kept_as_parquet_and_tables(spark, tmp_path):
    x = signal(3, 9, 8, complex_=False)
    t = Tiles.from_cells(load(spark, x, 1), (1, 4, 8))
    parquet.write_tiles(t, f"file://{tmp_path}/t", parquet.Options(partitions=3))
    back = parquet.read_tiles(spark, f"file://{tmp_path}/t")
    assert back.tiling == t.tiling and np.array_equal(dump(back), x) and np.array_equal(dump(parquet.read(spark, f"file://{tmp_path}/t")), x)
    store = parquet.Store(spark, f"file://{tmp_path}/store")
    store.write("as tiles", t)
    store.write("as cells", t.to_cells())
    assert np.array_equal(dump(store.read_tiles("as tiles")), x) and np.array_equal(dump(store.read("as tiles")), x)
    assert {(r["name"], tuple(r["global_shape"])) for r in store.catalog().collect()} == {("as tiles", (9, 8)), ("as cells", (9, 8))}
    with pytest.raises(IoError):
        store.read_tiles("as cells")
    names = [f"tiles_{n}_{abs(hash(str(tmp_path)))}" for n in range(3)]
    try:
        a, b, c = (t.save(n, 4) for n in names)
        made = a.pointwise(lambda u, v, w: u * v - w, b, c)
        plan = made.df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and np.allclose(dump(made), x * x - x)
        total = reduce.map_reduce([a, b], 0.0, lambda u, v: u * v, "sum")
        assert math.isclose(total.first()[0], float((x * x).sum()))
    finally:
        for n in names:
            spark.sql(f"drop table if exists {n}")


def test_cells_saved_by_coordinates_are_joined_where_they_are(spark, tmp_path):
    x = signal(3, 9, 8, complex_=False)
    a = load(spark, x, 1)
    names = [f"cells_{n}_{abs(hash(str(tmp_path)))}" for n in range(3)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = pointwise.pointwise3(*(a.save(n, 4) for n in names), lambda u, v, w: u * v - w)
        plan = made.df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and np.allclose(dump(made), x * x - x)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in names:
            spark.sql(f"drop table if exists {n}")


@pytest.mark.parametrize("tiles", [False, True])
def test_a_large_saved_array_has_more_buckets(spark, tmp_path, monkeypatch, tiles):
    monkeypatch.setattr(array, "BUCKET_CELLS", 20)
    x = signal(9, 24, complex_=False)
    a = Tiles.from_cells(load(spark, x), (1, 8)) if tiles else load(spark, x)
    names = [f"grown_{n}_{abs(hash(str(tmp_path)))}" for n in range(2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        u = a.save(names[0], 4)
        v = u.with_df(u.df).save(names[1], 4)
        # one file a bucket, of what was read bucket by bucket as well
        assert all(spark.table(n).select(F.input_file_name()).distinct().count() <= 11 for n in names)
        made = u.pointwise(lambda p, q: p * q, v) if tiles else pointwise.pointwise2(u, v, lambda p, q: p * q)
        found = {r["col_name"]: r["data_type"] for r in spark.sql(f"describe formatted {names[0]}").collect()}
        assert found["Num Buckets"] == "11" and "Exchange" not in made.df._jdf.queryExecution().executedPlan().toString()
        assert np.allclose(dump(made), x * x)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in names:
            spark.sql(f"drop table if exists {n}")


def test_tiles_move_values_alone(spark):
    x = signal(8, 8, 16, 16)
    a = load(spark, x)
    t = Tiles.from_cells(a, (4, 4, 16, 16))
    cells, tiles = (measured(T.C2c.like(b, options=STAGES).forward(b).df)[-1] for b in (a, t))
    # 16 bytes a cell and little more; coordinates of cells compress well in so small an array, but not away
    assert cells.rows_read == x.size and tiles.rows_read < x.size / 50
    assert tiles.bytes_read < 17 * x.size and 1.5 * tiles.bytes_read < cells.bytes_read


# long lines


@pytest.mark.parametrize("n, line", [(24, 8), (30, 8), (13, 4), (26, 6), (35, 7), (16, 4)])
def test_long_fourier_lines(spark, n, line):
    x, z = signal(2, n, complex_=False), signal(2, n)
    half = np.fft.rfft(x)
    for step, y in ((("fft", 1, -1), z), (("fft", 1, 1), z), (("rfft", 1, -1), x), (("rfft", 1, 1), x), (("crfft", 1, n), half), (("crfft", 1, -n), half), (("dht", 1, 0), x), (("dht", 1, 0), z)):
        want = kernels.apply(step, y, 1)
        after = {1: want.shape[1]} if step[0] in ("rfft", "crfft") else {}
        got = apply_steps(load(spark, y), [step], after, np.iscomplexobj(want), 1.0, Tuning(line_cells=line))
        assert np.allclose(dump(got), want, atol=1e-10), step


def test_a_long_real_line_moves_half_the_cells(spark):
    a = load(spark, signal(4, 64, complex_=False))
    plan = T.R2c.like(a, [1], options=T.Options(tuning=Tuning(line_cells=16)))
    uses = [u for u in measured(plan.forward(a).df) if u.rows_read]
    assert [u.rows_read for u in uses] == [256, 128]


@pytest.mark.parametrize("kind", kernels.R2R_KINDS)
@pytest.mark.parametrize("n", [65, 66, 127, 128, 1000])
def test_short_transforms_equal_the_sums(kind, n):
    x = signal(3, n, complex_=False)
    want = x @ kernels.basis(kind, n).T
    for y, z in ((x, want), (x + 1j * x[::-1], want + 1j * want[::-1])):
        got = kernels.r2r(kind, y, 1)
        assert np.abs(got - z).max() <= 2e-10 + 2e-12 * np.abs(z).max()


def test_holes_in_long_lines(spark):
    a = load(spark, signal(2, 24, complex_=False))
    for step, after, complex_ in ((("rfft", 1, -1), {1: 13}, True), (("dct3", 1, 0), {}, False)):
        with pytest.raises(TransformError, match="dense"), typed():
            apply_steps(a.with_df(a.df.filter("not (i0 = 1 and i1 = 7)")), [step], after, complex_, 1.0, Tuning(line_cells=8)).df.collect()


# folds


@pytest.mark.parametrize("fan", [2, 3, 4096])
def test_integer_sums_are_a_tree(spark, monkeypatch, fan):
    monkeypatch.setattr(reduce, "FAN", fan)
    for values, good in (([100, 27, -50, -77, 127], True), ([100, 28, -50], False), ([-100, -28, 1], True), ([-100, -29, 120], False), ([1] * 127, True), ([1] * 128, False)):
        for grid in ((1,), (3,)):
            a = NDArray.from_values(spark, Layout.of((len(values),)), values, dtype="i8")
            a = a.with_df(a.df, layout=Layout.of((len(values),), grid))
            total = reduce.global_sum(a)
            parts = np.array_split(values, grid[0]) if grid[0] == 1 else [values[len(values) * c // 3 : len(values) * (c + 1) // 3] for c in range(3)]
            runs = [np.cumsum(p) for p in parts if len(p)] + [np.cumsum([sum(p) for p in parts])]
            if all((-128 <= r).all() and (r <= 127).all() for r in runs):
                assert total.first()[0] == sum(values)
            else:
                with pytest.raises(ReductionError, match="overflow"), typed():
                    total.first()
            assert good == all((-128 <= np.cumsum(values)) & (np.cumsum(values) <= 127))
            assert "Window" not in total._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n, grid", [(10, 1), (9000, 1), (9000, 4), (3, 5)])
def test_a_neutral_value_counts_for_each_block_and_once_more(spark, n, grid):
    a = NDArray.from_elem(spark, Layout.of((n,), (grid,)), 1.0)
    for reducer in ("sum", lambda x, y: x + y):
        assert reduce.map_reduce([a], 1.0, lambda v: v, reducer).first()[0] == n + grid + 1
        assert reduce.map_reduce([a], 0.0, lambda v: v, reducer).first()[0] == n
    t = Tiles.from_cells(a, (4,))
    for reducer in ("sum", lambda x, y: x + y):
        assert reduce.map_reduce([t], 1.0, lambda v: v, reducer).first()[0] == n + -(-n // 4) + 1


def test_tiles_are_folded_where_they_are(spark):
    a = load(spark, np.arange(24.0).reshape(4, 6))
    t = Tiles.from_cells(a, (4, 3))
    t = t.with_df(spark.createDataFrame(t.df.toPandas(), t.df.schema))
    out = reduce.map_reduce([t], "", lambda v: F.concat(v.cast("int").cast("string"), F.lit(" ")), lambda x, y: F.concat(x, y), "string")
    want = [i * 6 + j for c in (0, 3) for i in range(4) for j in range(c, c + 3)]
    assert out.first()[0].split() == [str(i) for i in want]
    assert max(u.rows_read for u in measured(out)) == 2
