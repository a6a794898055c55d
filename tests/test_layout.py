import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftspark.errors import ArrayError, AxisError, GeometryError, LayoutError, ShapeError, TopologyError
from weftspark.operators import array
from weftspark.operators.array import MultiLayout, NDArray
from weftspark.plans.layout import AxisPermutation, BlockGrid, Decomposition, Layout, block_of, partition_range, row_major_offset


@given(st.integers(0, 500), st.integers(1, 40))
def test_partition_covers_and_balances(length, parts):
    ranges = [partition_range(length, parts, c) for c in range(parts)]
    assert ranges[0][0] == 0 and ranges[-1][1] == length
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    sizes = [b - a for a, b in ranges]
    assert max(sizes) - min(sizes) <= 1


@given(st.permutations(range(5)))
def test_permutation_round_trip(axes):
    p = AxisPermutation(tuple(axes))
    assert p.unpermute(p.permute((10, 11, 12, 13, 14))) == (10, 11, 12, 13, 14)
    assert all(p.axes[p.position_of(a)] == a for a in range(5))


@settings(max_examples=30)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=4))
def test_row_major_counts_up(shape):
    import itertools

    offsets = [row_major_offset(tuple(shape), i) for i in itertools.product(*map(range, shape))]
    assert offsets == list(range(math.prod(shape)))


def test_block_expression_inverts_the_partition(spark):
    for length, parts in ((7, 3), (12, 5), (3, 6), (1, 1)):
        got = [r[0] for r in spark.range(length).orderBy("id").select(block_of(F.col("id"), length, parts)).collect()]
        assert got == [next(c for c in range(parts) if partition_range(length, parts, c)[0] <= i < partition_range(length, parts, c)[1]) for i in range(length)]


def test_bad_layouts_are_refused():
    with pytest.raises(AxisError):
        AxisPermutation((0, 0))
    with pytest.raises(AxisError):
        Decomposition(2, (0, 0))
    with pytest.raises(AxisError):
        Decomposition(2, ())
    with pytest.raises(LayoutError):
        Layout.of((3, 0))
    with pytest.raises(TopologyError):
        BlockGrid((0,))
    with pytest.raises(TopologyError):
        Layout(((3, 4)), BlockGrid((2, 2)), Decomposition(2, (0,)), AxisPermutation.identity(2))
    with pytest.raises(GeometryError):
        partition_range(4, 2, 2)
    with pytest.raises(GeometryError):
        row_major_offset((2, 2), (2, 0))


def test_grids():
    assert BlockGrid.auto(12, 2).shape == (4, 3)
    assert BlockGrid.auto(6, 3).shape == (3, 2, 1)
    g = BlockGrid((2, 3))
    assert [g.rank_at(g.coords_of(r)) for r in range(6)] == list(range(6))
    assert g.line_size(1) == 3


def test_layout_derivations():
    a = Layout.of((4, 5, 6), (2, 3))
    assert a.with_decomposition((2, 1)).blocks_along == (1, 3, 2)
    assert a.ranges_at((1, 2)) == [(2, 4), (3, 5), (0, 6)]
    assert a.same_distribution(a.with_permutation((2, 1, 0))) and not a.same_layout(a.with_permutation((2, 1, 0)))
    assert a.reconfigured((2, 2, 2), (0, 2), (1, 0, 2)).shape == (2, 2, 2)


def test_construction_and_access(spark):
    layout = Layout.of((2, 3), permutation=(1, 0))
    a = NDArray.from_values(spark, layout, [0, 10, 1, 11, 2, 12], dtype="i32")
    assert {(r["i0"], r["i1"]): r["v"] for r in a.df.collect()} == {(i, j): 10 * i + j for i in range(2) for j in range(3)}
    assert a.at((1, 2)).first()["v"] == 12 and a.at((2, 0)).count() == 0
    assert [r["v"] for r in a.gather().collect()] == [0, 1, 2, 10, 11, 12]
    with pytest.raises(ShapeError):
        NDArray.from_values(spark, layout, [1])
    empty = NDArray.from_elem(spark, layout, 1.0, (0,))
    assert empty.df.count() == 0 and empty.validate_dense()


def test_from_table_fills_and_refuses(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0)], "i0 long, i1 long, v double")
    layout = Layout.of((2, 2))
    assert sorted(r["v"] for r in NDArray.from_table(rows, layout, fill=0.0).df.collect()) == [0.0, 0.0, 1.0, 2.0]
    for bad, fill in ((rows, None), (rows.union(rows), 0.0), (rows.withColumn("i0", F.col("i0") + 1), 0.0)):
        with pytest.raises(Exception, match="a cell"):
            NDArray.from_table(bad, layout, fill=fill).df.collect()
    with pytest.raises(ShapeError):
        NDArray.from_dense(rows, layout).validate_dense()


def test_from_table_combines_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(array, "TASK_CELLS", 50)
    rows = spark.range(1200).selectExpr("id % 20 as i0", "id % 30 as i1", "cast(id as double) as v")
    a = NDArray.from_table(rows, Layout.of((20, 30)), fill=-1.0, combine=F.sum)
    want = {}
    for k in range(1200):
        want[k % 20, k % 30] = want.get((k % 20, k % 30), 0.0) + k
    assert {(r["i0"], r["i1"]): r["v"] for r in a.df.collect()} == {(i, j): want.get((i, j), -1.0) for i in range(20) for j in range(30)}
    # one task for each 50 cells, whatever Spark's number of shuffle partitions, and none that is put together with others
    assert a.df.rdd.getNumPartitions() == 12


def test_grids_of_many_cells_have_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(array, "GRID_CELLS", 50)
    cells = NDArray.grid(spark, Layout.of((20, 30)), (2,))
    assert cells.rdd.getNumPartitions() == 24 and cells.distinct().count() == 1200


def test_many_layouts_share_one_array(spark):
    a = Layout.of((2, 2))
    b = a.with_permutation((1, 0))
    m = MultiLayout(NDArray.from_elem(spark, a, 1.0), (a, b))
    with pytest.raises(ZeroDivisionError):
        m.overwrite_with(1, lambda x: 1 / 0)
    assert m.active == 0
    m.overwrite_with(1, lambda x: x.with_df(x.df, layout=b))
    assert m.active == 1 and m.view(1).layout == b
    assert m.into_parts()[1:] == ((a, b), 1) and m.into_storage().count() == 4
    two = MultiLayout.from_values(spark, (a, b), [1.0, 2.0, 3.0, 4.0], active=1)
    assert two.view().at((0, 1)).first()["v"] == 3.0 and MultiLayout.from_elem(spark, (a,), 2.0).view(0).at((1, 1)).first()["v"] == 2.0
    with pytest.raises(ArrayError):
        MultiLayout(two.view(), (a, b), 0)


def test_lines_of_a_grid():
    grid = BlockGrid.from_cartesian((2, 3), (False, True))
    assert grid == BlockGrid((2, 3)) and grid.line(4, 1) == [3, 4, 5] and grid.line(4, 0) == [1, 4]
    with pytest.raises(TopologyError):
        BlockGrid.from_cartesian((2, 3), (True,))
