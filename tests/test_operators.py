import math

import pytest
from pyspark.sql import functions as F

from weftspark.errors import LocalGridError, MultiInputError, PointwiseError, ReductionError, RemapError, TransposeError, typed
from weftspark.operators import exchange, pointwise, reduce
from weftspark.operators.array import NDArray
from weftspark.plans.layout import Layout

INF, NAN = math.inf, math.nan


def line(spark, values, dtype="f64", grid=(1,)):
    return NDArray.from_values(spark, Layout.of((len(values),), grid), values, dtype=dtype)


def value(df):
    return df.first()["value"]


def same(a, b):
    return a == b or a is not None and b is not None and a != a and b != b


@pytest.mark.parametrize(
    "values, total, low, high, norm",
    [
        ([1.0, 2.0, -4.0], -1.0, -4.0, 2.0, math.sqrt(21)),
        ([NAN, 1.0], NAN, NAN, NAN, NAN),
        ([INF, 1.0], INF, 1.0, INF, INF),
        ([INF, -INF], NAN, -INF, INF, INF),
        ([1e308, 1e308, -INF], -INF, -INF, 1e308, INF),
        ([3e200, 4e200], 7e200, 3e200, 4e200, 5e200),
        ([3e-200, 4e-200], 7e-200, 3e-200, 4e-200, 5e-200),
        ([0.0, -0.0], 0.0, 0.0, 0.0, 0.0),
    ],
)
def test_special_values(spark, values, total, low, high, norm):
    a = line(spark, values)
    got = value(reduce.global_sum(a))
    assert same(got, total) or math.isclose(got, total, rel_tol=1e-14)
    assert same(value(reduce.global_min(a)), low) and same(value(reduce.global_max(a)), high)
    got = value(reduce.l2_norm(a))
    assert same(got, norm) or math.isclose(got, norm, rel_tol=1e-14)


def test_integer_sums_are_checked_in_order(spark):
    with pytest.raises(Exception, match="overflow"):
        value(reduce.global_sum(line(spark, [127, 1, -1], "i8")))
    assert value(reduce.global_sum(line(spark, [127, -1, 1], "i8"))) == 127
    assert value(reduce.global_sum(line(spark, [127, 1, -1], "i8"), checked="total")) == 127
    with pytest.raises(Exception, match="overflow"):
        value(reduce.global_sum(line(spark, [100, 100], "i8"), checked="total"))
    with pytest.raises(Exception, match="overflow"):
        value(reduce.global_sum(line(spark, [100, 0, 100, -100], "i8")))
    with pytest.raises(ReductionError, match="overflow"), typed():
        value(reduce.global_sum(line(spark, [100, 0, 100, -100], "i8")))
    # each block folds its own cells first
    assert value(reduce.global_sum(line(spark, [100, 0, 100, -100], "i8", grid=(2,)))) == 100
    assert value(reduce.global_sum(line(spark, [2**63 - 1, -1, 1], "i64"))) == 2**63 - 1


def test_empty_arrays(spark):
    a = NDArray.from_elem(spark, Layout.of((2,)), 1.0, (0,))
    assert value(reduce.global_sum(a)) == 0 and value(reduce.l2_norm(a)) == 0
    assert value(reduce.global_min(a)) is None
    assert value(reduce.any_(a)) is False and value(reduce.all_(a)) is True
    i = NDArray.from_elem(spark, Layout.of((2,)), 1, (0,), "i32")
    assert value(reduce.global_sum(i)) == 0


def test_truth(spark):
    assert value(reduce.any_(line(spark, [0.0, NAN]))) is True
    assert value(reduce.all_(line(spark, [1.0, 0.0]))) is False
    assert value(reduce.any_(line(spark, [0j, 1j], "c128"))) is True
    with pytest.raises(ReductionError):
        reduce.global_min(line(spark, [0j], "c128"))


@pytest.mark.parametrize("grid", [(1,), (4,), (6,)])
def test_ordered_reducers_keep_storage_order(spark, grid):
    a = line(spark, [1.0, 2.0, 3.0, 4.0, 5.0], grid=grid)
    # associative and not commutative: keep the second argument
    assert value(reduce.map_reduce([a], 0.0, lambda v: v, lambda x, y: y * 1.0)) == 5.0
    assert value(reduce.map_reduce([a], 0.0, lambda v: v, "sum")) == 15.0


def test_broadcasting_both_ways(spark):
    layout = Layout.of((2, 3))
    a = NDArray.from_fn(spark, layout, lambda c: c["x1"].cast("double"), (1, 3))
    b = NDArray.from_fn(spark, layout, lambda c: 100 + c["x0"].cast("double"), (2, 1))
    out = pointwise.pointwise2(a, b, lambda x, y: x + y + 7)
    assert out.extra == (2, 3) and out.validate_dense()
    assert {(r["x0"], r["x1"]): r["v"] for r in out.df.collect()} == {(i, j): 107.0 + i + j for i in range(2) for j in range(3)}
    two, three = NDArray.from_elem(spark, layout, 2.0, (1, 3)), NDArray.from_elem(spark, layout, 3.0, (2, 1))
    assert value(reduce.zip_sum_by(two, three, lambda x, y: x * y)) == 36 * 6
    wide = pointwise.pointwise2(NDArray.from_elem(spark, layout, 1.0, (1,)), NDArray.from_elem(spark, layout, 2.0, (1,)), lambda x, y: x + y, extra=(4,))
    assert wide.validate_dense().extra == (4,)
    none = pointwise.pointwise2(NDArray.from_elem(spark, layout, 1.0, (1,)), NDArray.from_elem(spark, layout, 2.0, (0,)), lambda x, y: x + y)
    assert none.df.count() == 0 and none.extra == (0,)
    with pytest.raises(PointwiseError):
        pointwise.pointwise2(NDArray.from_elem(spark, layout, 1.0, (2,)), NDArray.from_elem(spark, layout, 1.0, (3,)), lambda x, y: x)
    with pytest.raises(PointwiseError):
        pointwise.pointwise2(a, NDArray.from_elem(spark, Layout.of((3, 2)), 1.0, (1, 3)), lambda x, y: x)
    with pytest.raises(MultiInputError):
        pointwise.pointwise_many([], F.array_max)


def test_remap_is_its_definition(spark):
    n = (4, 5)
    a = NDArray.from_fn(spark, Layout.of(n), lambda c: c["i0"] * 10 + c["i1"], dtype="i64")
    for signs, offsets in (((1, 1), (1, -2)), ((-1, 1), (3, 9)), ((-1, -1), (0, 2**40))):
        got = {(r["i0"], r["i1"]): r["v"] for r in exchange.remap(a, signs, offsets).df.collect()}
        assert got == {(i, j): ((signs[0] * i + offsets[0]) % 4) * 10 + (signs[1] * j + offsets[1]) % 5 for i in range(4) for j in range(5)}
    with pytest.raises(RemapError):
        exchange.remap(a, (1, 2), (0, 0))


def test_transposes(spark):
    a = Layout.of((4, 6), (2,))
    b = a.with_decomposition((1,))
    x = NDArray.from_fn(spark, a, lambda c: c["i0"] * 6 + c["i1"], dtype="i64")
    moved = exchange.Transpose(a, b).materialise(x)
    assert {r["block"]: r["n"] for r in moved.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 12, 1: 12}
    assert moved.filter((F.col("i1") < 3) != (F.col("block") == 0)).count() == 0
    with pytest.raises(TransposeError):
        exchange.Transpose(a, a)
    with pytest.raises(TransposeError):
        exchange.LocalTranspose(a, b)
    assert [r["v"] for r in exchange.LocalTranspose(a, a.with_permutation((1, 0))).ordered(NDArray(x.df.coalesce(1), a, (), "i64")).collect()][:3] == [0, 6, 12]


def test_gather_and_agreement(spark):
    a = line(spark, [3.0, 1.0, 2.0], grid=(2,))
    assert [r["v"] for r in reduce.gather(a, 1).collect()] == [3.0, 1.0, 2.0]
    with pytest.raises(ReductionError):
        reduce.gather(a, 2)
    flags = spark.createDataFrame([(0, True), (1, False)], "block int, ok boolean")
    assert value(reduce.agreed(flags)) is False and value(reduce.agreed(flags.limit(0))) is True


def test_mapped_integer_sums_are_checked_in_order(spark):
    a = line(spark, [100, 27, -50], "i8")
    one, up = line(spark, [1, 1, 1], "i8"), lambda v: v + F.lit(0)
    assert value(reduce.sum_by(a, up)) == 77
    for f in (lambda c: reduce.sum_by(a, lambda v: v + 1, checked=c), lambda c: reduce.zip_sum_by(a, one, lambda x, y: x + y, checked=c), lambda c: reduce.sum_many_by([a, one], lambda v: v[0] + v[1], checked=c)):
        with pytest.raises(ReductionError, match="overflow"), typed():
            value(f("ordered"))
        assert value(f("total")) == 80
    assert value(reduce.sum_by(a, lambda v: v * 2, "i16")) == 154


@pytest.mark.parametrize("fan", [2, 3, 4096])
def test_functions_fold_in_order_through_a_tree(spark, monkeypatch, fan):
    monkeypatch.setattr(reduce, "FAN", fan)
    for grid in ((1,), (5,)):
        a = NDArray.from_fn(spark, Layout.of((40,), grid), lambda c: c["i0"].cast("double"))
        got = value(reduce.map_reduce([a], "", lambda v: F.concat(v.cast("int").cast("string"), F.lit(" ")), lambda x, y: F.concat(x, y), "string"))
        assert got.split() == [str(i) for i in range(40)]


def test_coordinate_tables_name_each_index_once(spark):
    a = NDArray.from_elem(spark, Layout.of((3,)), 1.0)
    good = spark.createDataFrame([(0, 0.5), (2, 2.5), (1, 1.5)], "i long, c double")
    assert sorted(r["c0"] for r in a.local_grid([good]).collect()) == [0.5, 1.5, 2.5]
    for bad in ([(0, 0.0), (0, 1.0), (1, 2.0)], [(0, 0.0), (1, 1.0), (3, 2.0)], [(0, 0.0)], [(0, 0.0), (1, 1.0), (1, 1.0), (2, 2.0)]):
        with pytest.raises(LocalGridError):
            a.local_grid([spark.createDataFrame(bad, "i long, c double")])


def test_norms_of_mixed_magnitudes(spark):
    for values in ([1e-320, 2e-320], [1e200, 1.0, 1e-200], [3.0, 4e-170], [1e-170] * 4, [1.7e308, 1.0]):
        got, want = value(reduce.l2_norm(line(spark, values))), math.hypot(*values)
        assert math.isclose(got, want, rel_tol=1e-13), values


def test_cells_are_written_where_they_are(spark):
    layout = Layout.of((2, 3), (2,))
    a = NDArray.from_elem(spark, layout, 1, dtype="i32")
    b = a.with_cell(7, (1, 2))
    assert b.at((1, 2)).first()["v"] == 7 and value(reduce.global_sum(b)) == 12
    assert value(reduce.global_sum(a.with_cell(7, (2, 0)))) == 6 and value(reduce.global_sum(a.with_cell(7, (1, 2), block=0))) == 6


def test_exchange_sizes_and_times(spark):
    source = Layout.of((4, 6), (2,))
    a = NDArray.from_elem(spark, source, 1.0)
    plan = exchange.Transpose(source, source.with_decomposition((1,)))
    assert sorted(map(tuple, plan.volume(a).collect())) == [(s, t, 6) for s in (0, 1) for t in (0, 1)]
    out, took = plan.with_timing(a)
    assert out.count() == 24 and took["total"] >= took["exchange"] >= 0 and took["pack"] > 0
