"""Queries of the other forms of the operators: forced stages and split lines, local plans over rows, in-place and timed
plans, layouts and their exchange, checked integer folds, and the forms of files that ``queries`` doesn't cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .functions.kernels import R2R_KINDS
from .operators import exchange, reduce
from .operators.array import MultiLayout, NDArray
from .plans.stages import Tuning, is_real, plane_norms
from .plans.transforms import BACKWARD, FORWARD, C2c, C2r, Dht, LocalC2c, LocalC2cNd, LocalDht, LocalR2c, LocalR2r, MixedC2c, MixedR2c, Options, R2c, R2r, transform_lines
from .queries import C, E2, E3, EMB, EMB_SHAPE, EMBC, EVT, LIN, LINC, ND, ORACLE, THREE, _block, _c2r_input, _folder, _three, c2r_sql, dft, final, lin_complex, query, r2r_sql, rounded, with_
from .sources import files, parquet

#: Every axis is a stage of its own, as in an array too large for slabs; and lines are split, as in one with long axes.
STAGES, LINES = Options(tuning=Tuning(slab_cells=1, small_cells=0)), Options(tuning=Tuning(line_cells=8))


# the paths that large arrays take


@query(ORACLE["c2c_forward"])
def q_c2c_forward_stages(spark, sf):
    a = tables.emb_complex(spark, sf)
    return rounded(C2c.like(a, options=STAGES).forward(a))


@query(ORACLE["c2c_inverse"])
def q_c2c_inverse_stages(spark, sf):
    a = lin_complex(spark, sf)
    return rounded(C2c.like(a, options=STAGES).inverse(a))


@query(ORACLE["c2c_directions"])
def q_c2c_directions_stages(spark, sf):
    a = lin_complex(spark, sf)
    return rounded(C2c.like(a, directions=(BACKWARD, FORWARD, BACKWARD), options=STAGES).forward(a))


@query(ORACLE["r2c_forward"])
def q_r2c_forward_stages(spark, sf):
    a = tables.evt(spark, sf)
    return rounded(R2c.like(a, options=STAGES).forward(a))


def _back(spark, sf, options: Options) -> DataFrame:
    a = tables.evt(spark, sf)
    plan = R2c.like(a, options=options)
    return rounded(plan.inverse(plan.forward(a))).withColumn("v", F.round("v", 5) + F.lit(0.0))


@query(ORACLE["r2c_inverse"])
def q_r2c_inverse_stages(spark, sf):
    return _back(spark, sf, STAGES)


@query(ORACLE["c2r_forward"])
def q_c2r_forward_stages(spark, sf):
    half = _c2r_input(spark, sf)[1]
    return rounded(C2r((7, 12, 8), options=STAGES, axes=[0, 2]).forward(half), 4)


@query(ORACLE["r2r_complex_axes"])
def q_r2r_stages(spark, sf):
    a = lin_complex(spark, sf)
    return rounded(R2r.like(a, ("dct1", None, "dst2"), options=STAGES).forward(a))


@query(ORACLE["dht_inverse"])
def q_dht_inverse_stages(spark, sf):
    a = tables.lin(spark, sf)
    return rounded(Dht.like(a, options=STAGES).inverse(a))


@query(ORACLE["mixed_c2c_inverse"])
def q_mixed_c2c_inverse_stages(spark, sf):
    a = lin_complex(spark, sf)
    return rounded(MixedC2c.like(a, ("fft", "dct2", "dht"), options=STAGES).inverse(a))


@query(ORACLE["mixed_r2c"])
def q_mixed_r2c_stages(spark, sf):
    a = tables.lin(spark, sf)
    return rounded(MixedR2c.like(a, ("fft", "rfft", "dht"), directions=(BACKWARD, FORWARD, FORWARD), options=STAGES).forward(a))


@query(ORACLE["mixed_r2c_round_trip"])
def q_mixed_r2c_round_trip_stages(spark, sf):
    a = tables.lin(spark, sf)
    plan = MixedR2c.like(a, ("dct4", "rfft", "dst1"), options=STAGES)
    return rounded(plan.inverse(plan.forward(a)))


@query(ORACLE["c2c_forward_1axis"])
def q_c2c_forward_split_lines(spark, sf):
    a = tables.emb_complex(spark, sf)
    return rounded(C2c.like(a, axes=[1], options=LINES).forward(a))


@query(ORACLE["r2c_forward"])
def q_r2c_forward_split_lines(spark, sf):
    a = tables.evt(spark, sf)
    return rounded(R2c.like(a, options=LINES).forward(a))


@query(ORACLE["r2c_inverse"])
def q_r2c_inverse_split_lines(spark, sf):
    return _back(spark, sf, LINES)


@query(ORACLE["dht_forward"])
def q_dht_forward_split_lines(spark, sf):
    a = tables.evt(spark, sf)
    return rounded(Dht.like(a, axes=[1], options=LINES).forward(a))


@query(ORACLE["r2r_complex_axes"])
def q_r2r_split_lines(spark, sf):
    a = lin_complex(spark, sf)
    return rounded(R2r.like(a, ("dct1", None, "dst2"), options=Options(tuning=Tuning(line_cells=5))).forward(a))


# spectra that no real array has


@query(with_(EVT, "p AS (SELECT x0, i0, f.k::BIGINT AS i1, sum(v * CASE WHEN f.k = 12 AND i1 % 2 = 1 THEN -1 ELSE 1 END) AS e FROM evt, (VALUES (0), (12)) AS f(k) GROUP BY x0, i0, f.k)", "SELECT x0, i1, round(sqrt(sum(e * e)), 3) + 0.0 AS norm, NOT (x0 = 1 AND i1 = 0 OR x0 = 2 AND i1 = 12) AS passes FROM p GROUP BY x0, i1"))
def q_endpoint_check_rejects(spark, sf):
    """A half spectrum in which one plane of two batches isn't real."""
    a = tables.evt(spark, sf)
    half = R2c.like(a, [1]).forward(a)
    wrong = F.expr("x0 = 1 and i1 = 0 or x0 = 2 and i1 = 12 and i0 = 3")
    half = half.with_df(half.df.withColumn("im", F.when(wrong, F.col("im") + 0.5).otherwise(F.col("im"))))
    planes = plane_norms(half, 1, 24)
    return planes.select("x0", "i1", (F.round("re", 3) + F.lit(0.0)).alias("norm"), is_real(0.0, 128 * 2.0**-52).alias("passes"))


# local plans over the rows of a table


def _lines(spark, sf) -> DataFrame:
    """Embeddings as lines, with the imaginary parts of ``emb_complex``."""
    rows = tables.table(spark, sf, "embeddings").select(F.col("vec_id").alias("i0"), F.col("embedding").cast("array<double>").alias("re"))
    return rows.withColumn("im", F.transform("re", lambda _, k: (F.col("i0") + k) % 7 / 8.0))


def _cells_of(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    zipped = df.select("i0", F.posexplode(F.arrays_zip(*names)).alias("i1", "z"))
    out = {"re": "v"} if names == ["re"] else {c: c for c in names}
    return zipped.select("i0", F.col("i1").cast("long").alias("i1"), *[(F.round(f"z.{c}", digits) + F.lit(0.0)).alias(v) for c, v in out.items()])


@query(with_(EMBC, dft("a", "embc", "i1", ["i0"], ND, -1), final("a", E2, C)))
def q_local_c2c_forward(spark, sf):
    return _cells_of(transform_lines(_lines(spark, sf), LocalC2c(64), im="im"), C)


@query(with_(EMBC, dft("a", "embc", "i1", ["i0"], ND, 1, scale=f"1.0 / {ND}"), final("a", E2, C, 9)))
def q_local_c2c_inverse(spark, sf):
    """Nine digits, as 512ths have no ties there."""
    return _cells_of(transform_lines(_lines(spark, sf), LocalC2c(64), "inverse", im="im"), C, 9)


_BLOCKS = EMBC + ", m AS (SELECT i0, i1 % 16 AS a, i1 // 16 AS b, re, im FROM embc)"


@query(with_(_BLOCKS, dft("p", "m", "b", ["i0", "a"], "4", -1), dft("q", "p", "a", ["i0", "b"], "16", -1), "SELECT i0, (a + 16 * b)::BIGINT AS i1, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM q"))
def q_local_c2c_nd(spark, sf):
    """Each line as a column-major block of 16 by 4."""
    return _cells_of(transform_lines(_lines(spark, sf), LocalC2cNd((16, 4), (1, 0)), im="im"), C)


@query(with_(EMB, dft("a", "emb", "i1", ["i0"], ND, -1, real=True, half=True), final("a", E2, C)))
def q_local_r2c_forward(spark, sf):
    return _cells_of(transform_lines(_lines(spark, sf).drop("im"), LocalR2c(64)), C)


@query(with_(EMBC, "h AS (SELECT i0, i1, re, CASE WHEN i1 IN (0, 63) THEN 0.0 ELSE im END AS im FROM embc)", c2r_sql("d", "h", "i1", ["i0"], "126"), final("d", E2, ["v"])))
def q_local_r2c_backward(spark, sf):
    """Lines as half spectra of 126 real values."""
    rows = _lines(spark, sf).withColumn("im", F.transform("im", lambda x, k: F.when(k.isin(0, 63), F.lit(0.0)).otherwise(x)))
    return _cells_of(transform_lines(rows, LocalR2c(126), "backward", im="im"), ["re"])


def _local_kind(kind: str) -> None:
    sql = with_(EMB, r2r_sql("a", "emb", "i1", ["i0"], 64, kind), final("a", E2, ["v"]))
    query(sql, f"local_r2r_{kind}")(lambda spark, sf: _cells_of(transform_lines(_lines(spark, sf).drop("im"), LocalR2r(64, kind)), ["re"]))


for _kind in R2R_KINDS:
    _local_kind(_kind)


@query(with_(EMB, r2r_sql("a", "emb", "i1", ["i0"], 64, "dht"), final("a", E2, ["v"])))
def q_local_dht(spark, sf):
    return _cells_of(transform_lines(_lines(spark, sf).drop("im"), LocalDht(64)), ["re"])


# plans: options, in place, timed, and what they say of themselves


@query(ORACLE["c2c_partial_axes"])
def q_c2c_point_to_point(spark, sf):
    """The other transport, the logical output order, and the overlapping form."""
    a = lin_complex(spark, sf)
    return rounded(C2c.like(a, axes=[2, 0], options=Options("point_to_point", False)).with_overlap(a))


@query(with_(LINC, final("linc", E3, C)))
def q_in_place_there_and_back(spark, sf):
    a = lin_complex(spark, sf)
    held = C2c.like(a).in_place(a).forward()
    assert held.view("output").shape == a.shape
    return rounded(held.inverse().view("input"))


@query(ORACLE["mixed_c2c"])
def q_mixed_c2c_with_timing(spark, sf):
    a = lin_complex(spark, sf)
    out, took = MixedC2c.like(a, ("fft", "dct2", "dht"), options=STAGES).with_timing(a)
    assert len(took.stages) == 3
    return rounded(out)


@query("""WITH e AS (SELECT max(l_orderkey) - min(l_orderkey) + 1 AS n, max(l_linenumber) AS m FROM lineitem), s AS (SELECT n, m, n || ',' || m || ',2' AS s FROM e)
SELECT 'c2c' AS plan, 'input' AS what, s AS value FROM s UNION ALL SELECT 'c2c', 'output', s FROM s UNION ALL SELECT 'c2c', 'stages', '2,1,0' UNION ALL SELECT 'c2c', 'factor', (n * m * 2)::VARCHAR FROM s
UNION ALL SELECT 'r2c', 'input', s FROM s UNION ALL SELECT 'r2c', 'output', n || ',' || (m // 2 + 1) || ',2' FROM s UNION ALL SELECT 'r2c', 'stages', '1,0' UNION ALL SELECT 'r2c', 'factor', (n * m)::VARCHAR FROM s
UNION ALL SELECT 'c2r', 'input', (n // 2 + 1) || ',' || m || ',2' FROM s UNION ALL SELECT 'c2r', 'output', s FROM s UNION ALL SELECT 'c2r', 'stages', '1,0' UNION ALL SELECT 'c2r', 'factor', (n * m)::VARCHAR FROM s
UNION ALL SELECT 'mixed', 'input', s FROM s UNION ALL SELECT 'mixed', 'output', n || ',' || (m // 2 + 1) || ',2' FROM s UNION ALL SELECT 'mixed', 'stages', '2,1,0' UNION ALL SELECT 'mixed', 'factor', (2 * n * m * 2)::VARCHAR FROM s""")
def q_plan_metadata(spark, sf):
    shape = tables.ord_(spark, sf).shape
    plans = {"c2c": C2c(shape), "r2c": R2c(shape, axes=[0, 1]), "c2r": C2r(shape, axes=[0, 1]), "mixed": MixedR2c(shape, transforms=("dct4", "rfft", "dht"))}
    text = lambda x: ",".join(map(str, x))
    rows = []
    for name, plan in plans.items():
        rows += [(name, "input", text(plan.input_shape)), (name, "output", text(plan.output_shape)), (name, "stages", text(k for s in plan.stage_geometry for k in s)), (name, "factor", str(plan.factor))]
    return spark.createDataFrame(rows, "plan string, what string, value string")


# layouts and their exchange


@query(with_(LIN, f"SELECT i0, i1, i2, ({_block('i2', 8, 2)} * 3 + {_block('i0', 7, 3)})::BIGINT AS block, ((i1 * 8 + i2) * 7 + i0)::BIGINT AS position FROM lin"))
def q_layout_reconfigured(spark, sf):
    a = tables.lin(spark, sf, grid=(2, 3))
    b = a.with_df(a.df, layout=a.layout.with_decomposition((2, 0)).with_permutation((1, 2, 0)))
    assert b.layout == a.layout.reconfigured(a.shape, (2, 0), (1, 2, 0)) and b.layout.with_shape(a.shape) == b.layout
    return b.df.select(*b.coords, b.block().alias("block"), b.physical().alias("position"))


@query(ORACLE["transpose_redistribute"])
def q_transpose_point_to_point(spark, sf):
    a = tables.lin(spark, sf, grid=(2, 3))
    return exchange.Transpose(a.layout, a.layout.with_decomposition((2, 1)), "point_to_point").materialise(a).select(*a.coords, "v", "block")


@query(ORACLE["transpose_redistribute"])
def q_transpose_with_callback(spark, sf):
    a = tables.lin(spark, sf, grid=(2, 3))
    moved = exchange.Transpose(a.layout, a.layout.with_decomposition((2, 1))).with_callback(a, lambda df: df.withColumn("v", F.col("v") * 2))
    return moved.select(*a.coords, (F.col("v") / 2).alias("v"), "block")


@query(ORACLE["transpose_redistribute"])
def q_transpose_in_place(spark, sf):
    """Through three layouts of one array: another distribution, then another memory order of it."""
    a = tables.lin(spark, sf, grid=(2, 3))
    b = a.layout.with_decomposition((2, 1))
    c = b.with_permutation((2, 1, 0))
    held = MultiLayout(a, (a.layout, b, c))
    exchange.Transpose(a.layout, b).in_place(held)
    exchange.LocalTranspose(b, c).in_place(held)
    cells, layouts, active = held.into_parts()
    return NDArray(cells, layouts[active]).with_block()


@query(with_(LIN, f"SELECT ({_block('i0', 7, 2)} * 3 + {_block('i1', 12, 3)})::BIGINT AS source, ({_block('i2', 8, 2)} * 3 + {_block('i1', 12, 3)})::BIGINT AS target, count(*) AS cells FROM lin GROUP BY 1, 2"))
def q_transpose_volume(spark, sf):
    a = tables.lin(spark, sf, grid=(2, 3))
    return exchange.Transpose(a.layout, a.layout.with_decomposition((2, 1))).volume(a)


@query(with_(LIN, f"SELECT bool_and(ok) AS value FROM (SELECT {_block('i0', 7, 2)} AS b, sum(v) > 0 AS ok FROM lin GROUP BY 1)"))
def q_all_blocks_agree(spark, sf):
    a = tables.lin(spark, sf, grid=(2,))
    return reduce.agreed(a.with_block().groupBy("block").agg((F.sum("v") > 0).alias("ok")))


@query(with_(LIN, "SELECT i0, i1, i2, CASE WHEN i0 = 3 AND i1 = 5 AND i2 = 2 THEN -1.0 ELSE v END AS v FROM lin"))
def q_set_global_point(spark, sf):
    return tables.lin(spark, sf).with_cell(-1.0, (3, 5, 2)).with_cell(-2.0, (7, 0, 0)).table()


# checked folds of integers


@query(with_(LIN, "SELECT sum(v * 2 - 1)::BIGINT AS value FROM lin"))
def q_sum_by_int(spark, sf):
    return reduce.sum_by(tables.lin(spark, sf, "i64", (2, 3)), lambda v: v * 2 - 1)


@query(with_(THREE, "SELECT sum(a * b)::BIGINT AS value FROM three"))
def q_zip_sum_by_int(spark, sf):
    a = tables.lin(spark, sf, "i64")
    return reduce.zip_sum_by(a, exchange.remap(a, (1, -1, 1), (0, 11, 0)), lambda x, y: x * y)


@query(with_(THREE, "SELECT sum(a + b - c)::BIGINT AS value FROM three"))
def q_sum_many_by_int(spark, sf):
    a = tables.lin(spark, sf, "i64")
    return reduce.sum_many_by([a, exchange.remap(a, (1, -1, 1), (0, 11, 0)), exchange.remap(a, (-1, 1, 1), (6, 0, 0))], lambda v: v[0] + v[1] - v[2])


@query(with_(THREE, "SELECT max(greatest(a, b, c)) AS value FROM three"))
def q_map_reduce_many_ordered(spark, sf):
    return reduce.map_reduce_many(_three(spark, sf), 0.0, F.array_max, F.greatest)


# files


@query(with_(LIN, "SELECT i0, i1, i2, v FROM lin"))
def q_raw_offset(spark, sf):
    """Cells after a head of other bytes, in either order of bytes."""
    a, path = tables.lin(spark, sf), f"{_folder(spark)}/raw"
    files.write_raw(path, a, head=b"a head of 21 bytes...")
    return files.read_raw(spark, path, a.layout, byte_offset=21, byte_order="little").table()


@query(with_(LIN, "SELECT i0, i1, i2, v::BIGINT * 256 AS v FROM lin"))
def q_raw_big_endian(spark, sf):
    """A whole number below 256, read the other way round in two bytes, is 256 times itself."""
    a, path = tables.lin(spark, sf, "i32"), f"{_folder(spark)}/raw"
    small = a.with_df(a.df.withColumn("v", (F.col("v") % 128).cast("smallint")), dtype="i16")
    files.write_raw(path, small, options=files.WriteOptions("independent", (("cb_nodes", "4"),)))
    high = files.read_raw(spark, path, a.layout, dtype="i16", byte_order="big")
    whole = a.df.join(high.df.withColumnRenamed("v", "h"), a.coords)
    return whole.select(*a.coords, (F.col("h").cast("long") + (F.col("v") - F.col("v") % 128).cast("long") * 256).alias("v"))


@query(with_(EVT, "SELECT 'pair' AS name, 0::BIGINT AS member, x0, i0, i1, v FROM evt UNION ALL SELECT 'pair', 1::BIGINT, x0, i0, i1, 2 * v FROM evt"))
def q_named_collection_read(spark, sf):
    a, path = tables.evt(spark, sf), f"{_folder(spark)}/named"
    files.write_named_collection(path, "pair", [a, a.with_df(a.df.withColumn("v", 2 * F.col("v")))])
    files.append_named_collection(path, "other", [a])
    out = [m.table().withColumn("member", F.lit(k).cast("long")) for k, m in enumerate(files.read_named_collection(spark, path, "pair", 2, a.layout, a.extra))]
    return out[0].unionByName(out[1]).withColumn("name", F.lit("pair"))


@query(with_(EVT, "SELECT 0::BIGINT AS x0, x0 AS x1, i0, i1, v FROM evt UNION ALL SELECT 1::BIGINT, x0, i0, i1, 2 * v FROM evt"))
def q_collection_read_stacked(spark, sf):
    a, path = tables.evt(spark, sf), f"{_folder(spark)}/members"
    files.write_collection(path, [a, a.with_df(a.df.withColumn("v", 2 * F.col("v")))])
    return files.read_stacked(spark, path, 2, a.layout, a.extra).table()


@query(with_(LIN, "SELECT 'one' AS name, i0, i1, i2, v FROM lin UNION ALL SELECT 'two', i0, i1, i2, v + 1 FROM lin"))
def q_file_session(spark, sf):
    a, path = tables.lin(spark, sf), f"{_folder(spark)}/session"
    with files.FileSession(spark, path, "create") as s:
        s.write("one", a)
        s.flush()
    with files.FileSession(spark, path, "append") as s:
        s.write("two", a.with_df(a.df.withColumn("v", F.col("v") + 1)))
    with files.FileSession(spark, path, "read") as s:
        out = [s.read(r["name"], a.layout).table().withColumn("name", F.lit(r["name"])) for r in s.catalog().collect()]
    return out[0].unionByName(out[1])


@query(f"SELECT name, dtype, s AS shape, '' AS extra FROM (VALUES ('array', 'f64'), ('blocks', 'f64')) AS t(name, dtype), {EMB_SHAPE}")
def q_file_catalogs(spark, sf):
    folder = _folder(spark)
    files.write_array(f"{folder}/array", tables.emb(spark, sf))
    files.write_chunked(f"{folder}/blocks", tables.emb(spark, sf, (4,)))
    found = files.catalog(spark, f"{folder}/array").withColumn("name", F.lit("array")).unionByName(files.chunked_catalog(spark, f"{folder}/blocks").withColumn("name", F.lit("blocks")))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("name", "dtype", join("global_shape").alias("shape"), join("extra_shape").alias("extra"))


@query(with_(LIN, "SELECT 0::BIGINT AS member, i0, i1, i2, v FROM lin UNION ALL SELECT 1::BIGINT, i0, i1, i2, -v FROM lin"))
def q_parquet_store(spark, sf):
    """Named arrays and a collection in Parquet, with storage options."""
    a, store = tables.lin(spark, sf), parquet.Store(spark, f"{_folder(spark)}/store")
    store.write_collection("pair/ü", [a, a.with_df(a.df.withColumn("v", -F.col("v")))], parquet.Options("snappy", 1 << 16, 3))
    store.write("single", a)
    assert store.names() == ["pair/ü", "single"]
    out = [m.table().withColumn("member", F.lit(k).cast("long")) for k, m in enumerate(store.read_collection("pair/ü"))]
    return out[0].unionByName(out[1])


@query(f"SELECT name, dtype, s AS shape FROM (VALUES ('run/3/velocity', 'f64'), ('run/3/mass', 'c128'), ('top', 'f64')) AS t(name, dtype), {EMB_SHAPE}")
def q_parquet_tree_catalog(spark, sf):
    path = f"{_folder(spark)}/tree"
    with parquet.TreeSession(spark, path, "create") as t:
        t.write("top", tables.emb(spark, sf))
        t.create_group("run")
        t.create_group("run/3")
        t.write("run/3/velocity", tables.emb(spark, sf))
    with parquet.TreeSession(spark, path, "append") as t:
        t.write("run/3/mass", tables.emb_complex(spark, sf))
    with parquet.TreeSession(spark, path, "read") as t:
        return t.catalog().select("name", "dtype", F.array_join(F.transform("global_shape", lambda x: x.cast("string")), ",").alias("shape"))


@query(with_(LIN, "SELECT i0, i1, i2, v FROM lin WHERE i0 = 2"))
def q_parquet_tree_read(spark, sf):
    """Part of an array of a tree: the filter reaches the scan."""
    path = f"{_folder(spark)}/tree"
    with parquet.TreeSession(spark, path, "create") as t:
        t.create_group("g")
        t.write("g/a", tables.lin(spark, sf), parquet.Options("gzip", None, 4))
    with parquet.TreeSession(spark, path, "read") as t:
        return t.read("g/a").table().filter("i0 = 2")
