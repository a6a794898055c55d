import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.errors import AxisError, CollectionError, InvalidSpectrum, TransformError, WrongState, typed
from weftspark.functions import kernels
from weftspark.operators.array import NDArray
from weftspark.plans import transforms as T
from weftspark.plans.layout import Layout
from weftspark.plans.stages import stage_axes


def load(spark, x, extra=0, grid=(1,)):
    """An array from a numpy array whose first ``extra`` axes are batches."""
    names = [f"x{k}" for k in range(extra)] + [f"i{k}" for k in range(x.ndim - extra)]
    complex_ = np.iscomplexobj(x)
    rows = [(*map(int, i), *((float(v.real), float(v.imag)) if complex_ else (float(v),))) for i, v in np.ndenumerate(x)]
    schema = ", ".join([*(f"{n} long" for n in names), *(("re double", "im double") if complex_ else ("v double",))])
    return NDArray(spark.createDataFrame(rows, schema), Layout.of(x.shape[extra:], grid), x.shape[:extra], "c128" if complex_ else "f64")


def dump(a):
    out = np.full((*a.extra, *a.shape), np.nan, complex if a.complex else float)
    for r in a.df.collect():
        out[tuple(r[c] for c in a.coords)] = complex(r["re"], r["im"]) if a.complex else r["v"]
    return out


def signal(*shape, seed=0, complex_=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=shape)
    return x + 1j * rng.normal(size=shape) if complex_ else x


def direct(kind, x, axis):
    """A transform by its defining sum."""
    x = np.moveaxis(x, axis, -1)
    n = x.shape[-1]
    j, k = np.arange(n), np.arange(n)[:, None]
    if kind == "dht":
        c = np.cos(2 * np.pi * j * k / n) + np.sin(2 * np.pi * j * k / n)
    elif kind == "dct1":
        c = 2 * np.cos(np.pi * j * k / (n - 1)) * np.where((j == 0) | (j == n - 1), 0.5, 1)
    elif kind == "dct2":
        c = 2 * np.cos(np.pi * (j + 0.5) * k / n)
    elif kind == "dct3":
        c = 2 * np.cos(np.pi * j * (k + 0.5) / n) * np.where(j == 0, 0.5, 1)
    elif kind == "dct4":
        c = 2 * np.cos(np.pi * (j + 0.5) * (k + 0.5) / n)
    elif kind == "dst1":
        c = 2 * np.sin(np.pi * (j + 1) * (k + 1) / (n + 1))
    elif kind == "dst2":
        c = 2 * np.sin(np.pi * (j + 0.5) * (k + 1) / n)
    elif kind == "dst3":
        c = 2 * np.sin(np.pi * (j + 1) * (k + 0.5) / n) * np.where(j == n - 1, 0.5, 1)
    else:
        c = 2 * np.sin(np.pi * (j + 0.5) * (k + 0.5) / n)
    return np.moveaxis(x @ c.T, -1, axis)


@pytest.mark.parametrize("kind", [*kernels.R2R_KINDS, "dht"])
@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 65, 130])
def test_real_kinds_by_their_sums(kind, n):
    if kind == "dct1" and n < 2:
        with pytest.raises(TransformError):
            kernels.check_length(kind, n)
        return
    run = (lambda x: kernels.dht(x, 1)) if kind == "dht" else (lambda x: kernels.r2r(kind, x, 1))
    for x in (signal(3, n, complex_=False), signal(3, n)):
        assert np.allclose(run(x), direct(kind, x, 1), rtol=2e-12, atol=2e-10)
    back = kernels.REVERSE[kind]
    again = direct(back, run(signal(3, n, complex_=False)), 1) / kernels.factor(kind, n)
    assert np.allclose(again, signal(3, n, complex_=False), atol=1e-9)


@pytest.mark.parametrize("shape, extra, axes", [((3, 4), 0, None), ((2, 3, 3, 2, 5), 2, None), ((2, 2, 1, 3, 4), 1, (0, 3)), ((2, 3, 2, 3), 0, ()), ((2, 3, 2, 3), 0, (0, 3))])
def test_complex(spark, shape, extra, axes):
    x = signal(*shape)
    a = load(spark, x, extra)
    plan = T.C2c.like(a, axes)
    used = tuple(extra + k for k in plan.axes.axes)
    assert np.allclose(dump(plan.forward(a)), np.fft.fftn(x, axes=used) if used else x, atol=1e-10)
    assert np.allclose(dump(plan.inverse(plan.forward(a))), x, atol=1e-10)
    assert np.allclose(dump(plan.backward(plan.forward(a))), x * plan.factor, atol=1e-9)


def test_directions(spark):
    x = signal(3, 4)
    a = load(spark, x)
    plan = T.C2c.like(a, directions=(T.BACKWARD, T.FORWARD))
    assert np.allclose(dump(plan.forward(a)), np.fft.fft(np.fft.ifft(x, axis=0, norm="forward"), axis=1), atol=1e-10)
    assert np.allclose(dump(plan.inverse(plan.forward(a))), x, atol=1e-10)
    with pytest.raises(TransformError):
        T.C2c.like(a, [0], directions=(T.FORWARD, T.BACKWARD))


@pytest.mark.parametrize("shape, extra, axes", [((3, 1), 0, None), ((3, 2), 0, None), ((2, 3, 3, 1, 4), 2, None), ((2, 3, 2, 3), 0, (0, 2)), ((2, 2, 3, 4), 1, (0, 2)), ((3, 1, 5), 0, (0,))])
def test_real_to_complex(spark, shape, extra, axes):
    x = signal(*shape, complex_=False)
    a = load(spark, x, extra)
    plan = T.R2c.like(a, axes)
    used = [extra + k for k in plan.axes.axes]
    want = np.fft.rfft(x, axis=used[-1])
    want = np.fft.fftn(want, axes=used[:-1]) if used[:-1] else want
    half = plan.forward(a)
    assert half.shape == plan.output_shape and np.allclose(dump(half), want, atol=1e-10)
    assert np.allclose(dump(plan.inverse(half)), x, atol=1e-10)
    assert np.allclose(dump(plan.backward(half)), x * plan.factor, atol=1e-9)


def test_spectrum_check(spark):
    x = signal(3, 4, complex_=False)
    a = load(spark, x)
    plan = T.R2c.like(a)
    bad = dump(plan.forward(a))
    bad[0, 0] += 0.5j
    with pytest.raises(Exception, match="InvalidSpectrum"):
        plan.inverse(load(spark, bad)).df.collect()
    bad = dump(plan.forward(a))
    bad[1, 2] = np.nan
    with pytest.raises(Exception, match="InvalidSpectrum"):
        plan.inverse(load(spark, bad)).df.collect()
    fine = dump(plan.forward(a))
    fine[0, 0] += 1e-17j
    assert np.allclose(dump(plan.inverse(load(spark, fine))), x, atol=1e-10)


@pytest.mark.parametrize("shape, axes", [((5, 3), None), ((4, 3, 2), (0, 2)), ((3, 4), (1,))])
def test_complex_to_real(spark, shape, axes):
    x = signal(*shape, complex_=False)
    a = load(spark, x)
    plan = T.C2r.like(a, axes)
    r, others = plan.real_axis, [k for k in plan.axes.axes if k != plan.real_axis]
    half = np.fft.rfft(x, axis=r)
    half = np.fft.fftn(half, axes=others) if others else half
    assert np.allclose(dump(plan.backward(a)), half, atol=1e-10)
    assert np.allclose(dump(plan.forward(plan.backward(a))), x * plan.factor, atol=1e-9)
    assert np.allclose(dump(plan.forward(plan.inverse(a))), x, atol=1e-10)


def test_real_plans_over_axes(spark):
    x = signal(2, 3, 4, complex_=False)
    a = load(spark, x)
    plan = T.R2r.like(a, ("dct1", None, "dst3"))
    assert np.allclose(dump(plan.forward(a)), direct("dct1", direct("dst3", x, 2), 0), atol=1e-10)
    assert np.allclose(dump(plan.inverse(plan.forward(a))), x, atol=1e-10)
    h = T.Dht.like(a, (0, 2))
    assert np.allclose(dump(h.forward(a)), direct("dht", direct("dht", x, 2), 0), atol=1e-10)
    assert np.allclose(dump(h.inverse(h.forward(a))), x, atol=1e-10)


@pytest.mark.parametrize("kinds", [("fft", "dct2", "dht"), (None, "fft", "dst4"), ("dct4", "dst1", "dst3")])
def test_mixed_complex(spark, kinds):
    x = signal(3, 2, 4)
    a = load(spark, x)
    plan = T.MixedC2c.like(a, kinds)
    want = x
    for k in (2, 1, 0):
        want = want if kinds[k] is None else np.fft.fft(want, axis=k) if kinds[k] == "fft" else direct(kinds[k], want, k)
    assert np.allclose(dump(plan.forward(a)), want, atol=1e-10)
    assert np.allclose(dump(plan.inverse(plan.forward(a))), x, atol=1e-10)
    assert np.allclose(dump(plan.backward(plan.forward(a))), x * plan.factor, atol=1e-8)


@pytest.mark.parametrize("kinds, shape", [(("rfft", "dct2", "dht"), (4, 3, 5)), (("fft", "rfft", "dht"), (3, 4, 5)), (("dct1", "rfft"), (3, 4))])
def test_mixed_real(spark, kinds, shape):
    x = signal(*shape, complex_=False)
    a = load(spark, x)
    plan = T.MixedR2c.like(a, kinds)
    want = x
    for k in reversed(range(len(shape))):
        t = kinds[k]
        want = np.fft.rfft(want, axis=k) if t == "rfft" else np.fft.fft(want, axis=k) if t == "fft" else direct(t, want, k)
    assert np.allclose(dump(plan.forward(a)), want, atol=1e-10)
    assert np.allclose(dump(plan.inverse(plan.forward(a))), x, atol=1e-10)
    assert np.allclose(dump(plan.backward(plan.forward(a))), x * plan.factor, atol=1e-8)


def test_plans_refuse(spark):
    with pytest.raises(AxisError):
        T.C2c((3, 4), axes=[0, 0])
    with pytest.raises(TransformError):
        T.R2c((3, 4), axes=[])
    with pytest.raises(TransformError):
        T.MixedC2c((3,), transforms=("rfft",))
    with pytest.raises(TransformError):
        T.MixedR2c((3, 4), transforms=("rfft", "fft"))
    with pytest.raises(TransformError):
        T.R2r((1,), kinds=("dct1",))
    a = load(spark, signal(2, 3))
    with pytest.raises(TransformError):
        T.C2c((3, 3)).forward(a)
    with pytest.raises(TransformError):
        T.R2c((2, 3)).forward(a)


def test_a_hole_is_noticed(spark):
    a = load(spark, signal(3, 4))
    holed = a.with_df(a.df.filter("not (i0 = 1 and i1 = 2)"))
    with pytest.raises(Exception, match="dense"):
        T.C2c.like(a).forward(holed).df.collect()


def test_collections_and_state(spark):
    x, y = signal(2, 3), signal(2, 3, seed=1)
    a, b = load(spark, x), load(spark, y)
    plan = T.C2c.like(a)
    out = plan.forward_many([a, b])
    assert np.allclose(dump(out[0]), np.fft.fftn(x)) and np.allclose(dump(out[1]), np.fft.fftn(y))
    with pytest.raises(CollectionError):
        plan.forward_many([])
    with pytest.raises(CollectionError) as e:
        plan.forward_many([a, load(spark, signal(3, 3))])
    assert e.value.member == 1
    held = plan.in_place(a)
    with pytest.raises(WrongState):
        held.inverse()
    assert held.forward().state == "output" and np.allclose(dump(held.inverse().array), x)


def test_single_precision_keeps_its_type(spark):
    x = signal(2, 4, complex_=False)
    a = load(spark, x)
    f = a.with_df(a.df.withColumn("v", F.col("v").cast("float")), dtype="f32")
    half = T.R2c.like(f).forward(f)
    assert half.dtype == "c64" and dict(half.df.dtypes)["re"] == "float"
    back = T.R2c.like(f).inverse(half)
    assert back.dtype == "f32" and np.allclose(dump(back), x, atol=1e-5)


def test_stages_are_few():
    assert stage_axes([4, 4, 4], 64) == [3]
    assert stage_axes([512, 512, 512], 512**3) == [2, 1]
    assert stage_axes([1 << 20, 1 << 20], 1 << 40) == [1, 1]


def test_one_exchange_for_each_stage(spark):
    a = NDArray.from_fn(spark, Layout.of((8, 8)), lambda c: (c["i0"] * 1.0, c["i1"] * 0.0), dtype="c128")
    plan = T.C2c.like(a, [1]).forward(a).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("tuning", [T.Tuning(1, 0), T.Tuning(line_cells=3), T.Tuning(slab_cells=24)])
def test_stages_and_split_lines_change_nothing(spark, tuning):
    x = signal(2, 6, 5, 8)
    options = T.Options(tuning=tuning)
    a = load(spark, x, 1)
    plan = T.C2c.like(a, options=options)
    assert np.allclose(dump(plan.forward(a)), np.fft.fftn(x, axes=(1, 2, 3))) and np.allclose(dump(plan.inverse(plan.forward(a))), x)
    for n in (8, 9):
        r = signal(4, n, complex_=False)
        b = load(spark, r)
        half = T.R2c.like(b, options=options)
        assert np.allclose(dump(half.forward(b)), np.fft.rfft2(r)) and np.allclose(dump(half.inverse(half.forward(b))), r)
    c = load(spark, signal(6, 4, complex_=False))
    real = T.C2r.like(c, options=options, axes=[0, 1])
    assert np.allclose(dump(real.inverse(real.forward(real.backward(c)))), dump(real.backward(c)))
    d = T.Dht.like(a, options=options)
    assert np.allclose(dump(d.inverse(d.forward(a))), x)
    e = T.Dht.like(c, options=options)
    assert np.allclose(dump(e.forward(c)), direct("dht", direct("dht", dump(c), 0), 1))
    m = T.MixedR2c.like(c, ("dct2", "rfft"), options=options)
    assert np.allclose(dump(m.inverse(m.forward(c))), dump(c))


@pytest.mark.parametrize("kind", kernels.R2R_KINDS)
def test_long_lines_of_real_kinds(spark, kind):
    options = T.Options(tuning=T.Tuning(line_cells=4))
    x, y = signal(3, 6, complex_=False), signal(2, 5)
    a, b = load(spark, x), load(spark, y)
    assert np.allclose(dump(T.R2r.like(a, (None, kind), options=options).forward(a)), direct(kind, x, 1))
    plan = T.R2r.like(b, (None, kind), options=options)
    assert np.allclose(dump(plan.forward(b)), direct(kind, y, 1)) and np.allclose(dump(plan.inverse(plan.forward(b))), y)


def test_split_lines_keep_the_type_and_refuse_holes(spark):
    x = signal(3, 12, complex_=False)
    a = load(spark, x)
    f = a.with_df(a.df.withColumn("v", F.col("v").cast("float")), dtype="f32")
    plan = T.R2c.like(f, [1], options=T.Options(tuning=T.Tuning(line_cells=3)))
    assert plan.forward(f).dtype == "c64" and np.allclose(dump(plan.forward(f)), np.fft.rfft(x), atol=1e-4)
    with pytest.raises(TransformError, match="dense"), typed():
        plan.forward(a.with_df(a.df.filter("not (i0 = 1 and i1 = 7)"))).df.collect()
    # a prime length has no factors to split by
    p = load(spark, signal(2, 13))
    assert np.allclose(dump(T.C2c.like(p, [1], options=T.Options(tuning=T.Tuning(line_cells=3))).forward(p)), np.fft.fft(dump(p)))


@pytest.mark.parametrize("axes", [[0, 1, 2], [2]])
def test_a_spectrum_that_no_real_array_has(spark, axes):
    x = signal(2, 4, 3, 6, complex_=False)
    a = load(spark, x, 1)
    plan = T.R2c.like(a, axes)
    half = plan.forward(a)
    assert plan.check_spectrum(half) is half
    for i2 in (0, 3):
        wrong = half.with_df(half.df.withColumn("im", F.when(F.expr(f"x0 = 1 and i0 = 2 and i1 = 1 and i2 = {i2}"), F.col("im") + 0.01).otherwise(F.col("im"))))
        with pytest.raises(InvalidSpectrum):
            plan.check_spectrum(wrong)
        for operation in (plan.inverse, plan.backward):
            with pytest.raises(InvalidSpectrum), typed():
                operation(wrong).df.collect()
    odd = half.with_df(half.df.withColumn("re", F.when(F.expr("x0 = 0 and i0 = 0 and i1 = 0 and i2 = 0"), F.lit(float("nan"))).otherwise(F.col("re"))))
    with pytest.raises(InvalidSpectrum):
        plan.check_spectrum(odd)
    with pytest.raises(TransformError):
        T.C2c.like(half).check_spectrum(half)


def test_the_check_costs_its_planes_only(spark):
    a = load(spark, signal(4, 16, complex_=False))
    plan = T.R2c.like(a)
    text = plan.inverse(plan.forward(a)).df._jdf.queryExecution().optimizedPlan().toString()
    # the planes are filtered before anything is transformed, in the subquery that checks them
    assert text.count("i1#") and "IN (0,8)" in text.replace(" ", "").replace("IN(0,8)", "IN (0,8)")


def test_members_are_computed_one_by_one_or_in_one_job(spark):
    x, y = signal(2, 3), signal(2, 3, seed=1)
    a, b = load(spark, x), load(spark, y)
    plan = T.C2c.like(a)
    out = plan.inverse_many(plan.forward_many([a, b]))
    assert np.allclose(dump(out[0]), x) and np.allclose(dump(out[1]), y)
    assert out[0].df._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    joined = plan.stacked([a, b], "backward")
    assert joined.extra == (2,) and np.allclose(dump(joined), np.stack([np.fft.ifftn(x, norm="forward"), np.fft.ifftn(y, norm="forward")]))
    held = plan.in_place_many([a, b])
    assert np.allclose(dump(held[1].forward().view("output")), np.fft.fftn(y))
    with pytest.raises(WrongState):
        held[1].view("input")
    assert plan.allocate_in_place(spark, "c128").view("input").validate_dense()


def test_lines_of_a_table(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0], [0.0] * 4, "a"), (2, [], [], "b"), (3, None, None, "c"), (4, [0.5] * 8, [1.0] * 8, None)]
    df = spark.createDataFrame(rows, "id long, re array<double>, im array<double>, tag string")
    got = {r["id"]: r for r in T.transform_lines(df, T.LocalC2c(4), im="im").collect()}
    for i, re, im, tag in rows:
        want = np.fft.fft((np.array(re or []) + 1j * np.array(im or [])).reshape(-1, 4)).ravel()
        assert np.allclose(np.array(got[i]["re"]) + 1j * np.array(got[i]["im"]), want) and got[i]["tag"] == tag
    half = {r["id"]: r for r in T.transform_lines(df.drop("im"), T.LocalR2c(4)).collect()}
    assert np.allclose(np.array(half[1]["re"]) + 1j * np.array(half[1]["im"]), np.fft.rfft([1, 2, 3, 4])) and len(half[4]["re"]) == 6
    assert T.transform_lines(df.limit(0), T.LocalC2c(4), im="im").count() == 0
    with pytest.raises(Exception, match="lines of 3"):
        T.transform_lines(df, T.LocalC2c(3), im="im").collect()


def test_local_plans():
    x = signal(24)
    assert np.allclose(T.LocalC2c(6).forward(x).reshape(4, 6), np.fft.fft(x.reshape(4, 6)))
    assert np.allclose(T.LocalC2c(6).inverse(T.LocalC2c(6).forward(x)), x)
    nd = T.LocalC2cNd((2, 3, 4), (2, 0))
    assert np.allclose(nd.forward(x).reshape((2, 3, 4), order="F"), np.fft.fftn(x.reshape((2, 3, 4), order="F"), axes=(0, 2)))
    assert np.allclose(nd.inverse(nd.forward(x)), x)
    r = signal(12, complex_=False)
    half = T.LocalR2c(4).forward(r)
    assert np.allclose(T.LocalR2c(4).inverse(half), r)
    half[0] += 1e-300j
    with pytest.raises(TransformError):
        T.LocalR2c(4).inverse(half)
    for kind in kernels.R2R_KINDS:
        assert np.allclose(T.LocalR2r(4, kind).inverse(T.LocalR2r(4, kind).forward(r)), r)
    assert np.allclose(T.LocalDht(4).inverse(T.LocalDht(4).forward(r)), r)
    assert T.LocalC2c(4).forward(np.zeros(0)).size == 0
    assert all(x.backend_kind() == "numpy" and x.backend_options() == {} for x in (T.LocalC2c(4), nd, T.LocalR2c(4), T.LocalR2r(4, "dct2"), T.LocalDht(4), T.C2c((2,))))
    with pytest.raises(TransformError):
        T.LocalC2c(5).forward(x)


@pytest.mark.parametrize("n", [1, 6, 7])
def test_packed_lines(n):
    x = signal(3, n, complex_=False)
    held = T.PackedR2c(T.LocalR2c(n), 3)
    held.real_view[:] = x
    with pytest.raises(WrongState):
        held.complex_view
    assert np.allclose(held.forward_in_place().complex_view, np.fft.rfft(x))
    with pytest.raises(WrongState):
        held.forward_in_place()
    assert np.allclose(held.inverse_in_place().real_view, x)
    held.forward_in_place().complex_view[0, 0] += 1j
    with pytest.raises(TransformError):
        held.inverse_in_place()
    assert held.state == "poisoned"


def test_plans_describe_themselves(spark):
    plan = T.R2c((6, 4), (2,), T.Options("point_to_point", False), axes=[0, 1])
    assert plan.stage_geometry == [(1, 0)] and plan.backend_kind() == "numpy"
    assert plan.allocate_input(spark, "f64").validate_dense().shape == (6, 4)
    assert plan.allocate_output(spark, "c128").validate_dense().shape == (6, 3)
    x = signal(2, 6, 4, complex_=False)
    a = NDArray.from_numpy(spark, x, extra_rank=1)
    out, took = plan.with_timing(a)
    assert took.total > 0 and [x for x, _ in took.stages] == [(1, 0)] and np.allclose(dump(out), np.fft.rfft2(x)) and out.layout.permutation.axes == (0, 1)
    assert np.allclose(dump(plan.with_overlap(a)), np.fft.rfft2(x))
    with pytest.raises(TransformError):
        T.C2c((2, 2)).with_overlap(load(spark, signal(2, 2)))
    assert T.C2c((4, 4), axes=[]).stage_geometry == [] and T.C2r((4, 6)).stage_geometry == [(1, 0)]


def test_axis_order_is_free():
    assert T.AxisSelection.from_indices(3, [2, 0]) == T.AxisSelection.from_indices(3, (0, 2))


@pytest.mark.parametrize(
    "make, family",
    [
        (lambda: T.C2c((0,)), "FftError"),
        (lambda: T.C2c((3,), directions=(1,), axes=[]), "FftError"),
        (lambda: T.R2c((3,), axes=[]), "R2cError"),
        (lambda: T.C2r((3,), axes=[]), "R2cError"),
        (lambda: T.R2r((3,), kinds=("dct9",)), "R2rError"),
        (lambda: T.MixedC2c((3,), transforms=("rfft",)), "MixedError"),
        (lambda: T.MixedR2c((3,), transforms=("fft",)), "MixedError"),
        (lambda: T.C2c((2,)).with_overlap(None), "OverlapError"),
        (lambda: T.LocalC2c(4).forward([1, 2, 3]), "LocalC2cError"),
        (lambda: T.LocalC2cNd((2, 2), (0,)).forward([1, 2, 3]), "LocalC2cNdError"),
        (lambda: T.LocalR2c(4).backward([1j, 2, 3]), "LocalR2cError"),
        (lambda: T.LocalDht(4).forward([1.0, 2.0, 3.0]), "LocalR2rError"),
    ],
)
def test_each_family_has_an_error(make, family):
    with pytest.raises(TransformError) as e:
        make()
    assert type(e.value).__name__ == family


def test_cells_come_with_this_library_s_errors(spark):
    a = load(spark, signal(3, 4))
    assert len(a.collect()) == 12
    with pytest.raises(TransformError, match="dense"):
        T.C2c.like(a, [1]).forward(a.with_df(a.df.filter("i1 <> 2"))).collect()
