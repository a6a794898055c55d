"""Queries of the forms that large arrays take: tiles, tables by block, lines that no task holds, arrays that grow."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import tables
from .functions.kernels import R2R_KINDS
from .operators import pointwise, reduce
from .operators.tiles import Tiles
from .plans.stages import Tuning
from .plans.transforms import BACKWARD, FORWARD, C2c, MixedR2c, Options, R2c, R2r
from .queries import C, E3, LIN, LINC, ORACLE, _folder, dft, final, lin_complex, query, r2r_sql, rounded, with_
from .sources import datasource, files, parquet

ORD = """ends AS (SELECT min(l_orderkey) AS a, max(l_orderkey) AS b, max(l_linenumber) AS n FROM lineitem),
sums AS (SELECT l_orderkey - a AS i0, l_linenumber - 1 AS i1, k AS i2, sum(CASE WHEN k = 0 THEN l_quantity ELSE l_discount END)::DOUBLE AS v
  FROM lineitem, ends, unnest(range(0, 2)) AS u(k) GROUP BY ALL),
ord AS (SELECT x.i0, y.i1, z.i2, coalesce(s.v, 0.0) AS v
  FROM ends, unnest(range(0, b - a + 1)) AS x(i0), unnest(range(0, n)) AS y(i1), unnest(range(0, 2)) AS z(i2) LEFT JOIN sums s ON s.i0 = x.i0 AND s.i1 = y.i1 AND s.i2 = z.i2)"""


# lines that no task holds


def _split(kind: str) -> None:
    sql = with_(LIN, r2r_sql("a", "lin", "i1", ["i0", "i2"], 12, kind), final("a", E3, ["v"]))

    @query(sql, f"r2r_{kind}_split_lines")
    def q(spark, sf):
        a = tables.lin(spark, sf)
        return rounded(R2r.like(a, (None, kind, None), options=Options(tuning=Tuning(line_cells=6))).forward(a))


for _kind in R2R_KINDS:
    _split(_kind)


@query(with_(LINC, dft("a", "linc", "i0", ["i1", "i2"], "7", -1), final("a", E3, C)))
def q_c2c_forward_prime_lines(spark, sf):
    """An axis of 7 cells as one whose lines have no factors and are too long."""
    a = lin_complex(spark, sf)
    return rounded(C2c.like(a, [0], options=Options(tuning=Tuning(line_cells=4))).forward(a))


@query(with_(LIN, dft("a", "lin", "i0", ["i1", "i2"], "7", -1, real=True, half=True), final("a", E3, C)))
def q_r2c_forward_prime_lines(spark, sf):
    a = tables.lin(spark, sf)
    return rounded(R2c.like(a, [0], options=Options(tuning=Tuning(line_cells=4))).forward(a))


# tables by block


@query(with_(ORD, final("(SELECT i0, i1, i2, v * (v + 1) - 2 * v AS v FROM ord)", E3, ["v"])))
def q_pointwise3_saved(spark, sf):
    """Three arrays of cells, saved in buckets by coordinates, combined without an exchange."""
    run = uuid.uuid4().hex[:12]
    a = tables.ord_(spark, sf).save(f"weftspark_cells_a_{run}", 8)
    b = a.with_df(a.df.withColumn("v", F.col("v") + 1)).save(f"weftspark_cells_b_{run}", 8)
    c = a.with_df(a.df.withColumn("v", 2 * F.col("v"))).save(f"weftspark_cells_c_{run}", 8)
    return rounded(pointwise.pointwise3(a, b, c, lambda x, y, z: x * y - z))


# tiles


@query(with_(ORD, final("ord", E3, ["v"])))
def q_tiles_round_trip(spark, sf):
    return rounded(Tiles.from_cells(tables.ord_(spark, sf), cells=4096).to_cells())


@query(with_(ORD, dft("a", "ord", "i1", ["i0", "i2"], "(SELECT n FROM ends)", -1, real=True, half=True), final("a", E3, C)))
def q_tiles_r2c_growing(spark, sf):
    t = Tiles.from_cells(tables.ord_(spark, sf), cells=4096)
    return rounded(R2c.like(t, [1]).forward(t).to_cells())


@query(ORACLE["c2c_forward"])
def q_tiles_c2c_forward(spark, sf):
    t = Tiles.from_cells(tables.emb_complex(spark, sf), (100, 10))
    return rounded(C2c.like(t).forward(t).to_cells())


@query(ORACLE["c2c_inverse"])
def q_tiles_c2c_inverse(spark, sf):
    t = Tiles.from_cells(lin_complex(spark, sf), (2, 5, 3))
    return rounded(C2c.like(t).inverse(t).to_cells())


@query(ORACLE["c2c_directions"])
def q_tiles_c2c_directions(spark, sf):
    t = Tiles.from_cells(lin_complex(spark, sf), (3, 12, 2))
    return rounded(C2c.like(t, directions=(BACKWARD, FORWARD, BACKWARD), options=Options(tuning=Tuning(slab_cells=1, small_cells=0))).forward(t).to_cells())


@query(ORACLE["r2c_forward"])
def q_tiles_r2c_forward(spark, sf):
    t = Tiles.from_cells(tables.evt(spark, sf), (2, 7, 5))
    return rounded(R2c.like(t).forward(t).to_cells())


@query(ORACLE["r2c_inverse"])
def q_tiles_r2c_inverse(spark, sf):
    t = Tiles.from_cells(tables.evt(spark, sf), (2, 7, 5))
    plan = R2c.like(t)
    return rounded(plan.inverse(plan.forward(t)).to_cells()).withColumn("v", F.round("v", 5) + F.lit(0.0))


@query(ORACLE["r2r_complex_axes"])
def q_tiles_r2r(spark, sf):
    t = Tiles.from_cells(lin_complex(spark, sf), (4, 4, 4))
    return rounded(R2r.like(t, ("dct1", None, "dst2")).forward(t).to_cells())


@query(ORACLE["mixed_r2c"])
def q_tiles_mixed_r2c(spark, sf):
    t = Tiles.from_cells(tables.lin(spark, sf), (4, 4, 4))
    return rounded(MixedR2c.like(t, ("fft", "rfft", "dht"), directions=(BACKWARD, FORWARD, FORWARD)).forward(t).to_cells())


@query(with_(ORD, final("ord", E3, ["v"])))
def q_tiles_parquet_round_trip(spark, sf):
    path = f"{_folder(spark)}/tiles"
    parquet.write_tiles(Tiles.from_cells(tables.ord_(spark, sf), cells=4096), path, parquet.Options(partitions=4))
    return rounded(parquet.read_tiles(spark, path).to_cells())


@query(with_(ORD, final("(SELECT i0, i1, i2, v * (v + 1) - 2 * v AS v FROM ord)", E3, ["v"])))
def q_tiles_pointwise_saved(spark, sf):
    """Three arrays saved by block, combined without an exchange."""
    t = Tiles.from_cells(tables.ord_(spark, sf), cells=4096)
    run = uuid.uuid4().hex[:12]
    a = t.save(f"weftspark_a_{run}", 8)
    b = a.with_df(a.df.select("block_id", "origin", "extent", F.transform("v", lambda v: v + 1).alias("v"))).save(f"weftspark_b_{run}", 8)
    c = a.with_df(a.df.select("block_id", "origin", "extent", F.transform("v", lambda v: 2 * v).alias("v"))).save(f"weftspark_c_{run}", 8)
    return rounded(a.pointwise(lambda x, y, z: x * y - z, b, c).to_cells())


@query(with_(ORD, final("ord WHERE i1 BETWEEN 2 AND 4 AND i2 = 1", E3, ["v"])))
def q_array_file_slice(spark, sf):
    """Part of an array file by the data source, which reads the byte ranges of that part only."""
    path = f"{_folder(spark)}/slice"
    files.write_array(path, tables.ord_(spark, sf))
    return rounded(datasource.scan(spark, path, where={"i1": (2, 5), "i2": 1}))


@query(with_(ORD, "SELECT i2, round(sum(v), 4) AS v FROM ord GROUP BY i2"))
def q_array_file_scan(spark, sf):
    path = f"{_folder(spark)}/scan"
    files.write_array(path, tables.ord_(spark, sf))
    return datasource.scan(spark, path).df.groupBy("i2").agg(F.round(F.sum("v"), 4).alias("v"))


@query(with_(ORD, "SELECT round(sum(v * v + 1), 2) + 0.0 AS value FROM ord"))
def q_tiles_map_reduce(spark, sf):
    """Each tile is folded where it is, in order; only its result moves."""
    t = Tiles.from_cells(tables.ord_(spark, sf), cells=4096)
    return reduce.map_reduce([t], 0.0, lambda v: v * v + 1, lambda x, y: x + y).select((F.round("value", 2) + F.lit(0.0)).alias("value"))
