"""Registered queries of the array engine and, for each, SQL over the same tables.

Values are rounded here and in the SQL, never inside operators; ``+ 0.0`` makes -0.0 and 0.0 alike.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .functions.kernels import R2R_KINDS, REVERSE, factor
from .operators import exchange, pointwise, reduce
from .operators.array import NDArray
from .plans.layout import Layout, block_of, range_of
from .plans.transforms import BACKWARD, FORWARD, C2c, C2r, Dht, MixedC2c, MixedR2c, R2c, R2r
from .plans.stages import is_real, plane_norms
from .sources import files, parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query with its SQL."""

    def add(f: Query) -> Query:
        key = name or f.__name__.removeprefix("q_")
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


def rounded(array: NDArray, digits: int = 6) -> DataFrame:
    return array.df.select(*array.coords, *[(F.round(F.col(v).cast("double"), digits) + F.lit(0.0)).alias(v) for v in array.values])


def one(df: DataFrame, digits: int = 6) -> DataFrame:
    """A reduction's row; fractions are rounded."""
    kind = dict(df.dtypes)["value"]
    return df.select((F.round(F.col("value").cast("double"), digits) + F.lit(0.0)).alias("value")) if kind in ("double", "float") else df


# SQL parts

EMB = """emb AS (SELECT vec_id AS i0, (u.k - 1)::BIGINT AS i1, embedding[u.k]::DOUBLE AS v
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(k))"""
EMBC = EMB + """,
embc AS (SELECT i0, i1, v AS re, ((i0 + i1) % 7)::DOUBLE / 8 AS im FROM emb)"""
EVT = """kinds AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::BIGINT AS x0 FROM (SELECT DISTINCT event_type FROM events)),
days AS (SELECT min(ts)::DATE AS d0, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS n FROM events),
raw AS (SELECT x0, date_diff('day', d0, ts::DATE) AS i0, hour(ts) AS i1, sum(value) AS v FROM events JOIN kinds USING (event_type), days GROUP BY ALL),
grid AS (SELECT x0, a.i0::BIGINT AS i0, b.i1::BIGINT AS i1 FROM kinds, days, unnest(range(0, days.n)) AS a(i0), unnest(range(0, 24)) AS b(i1)),
evt AS (SELECT g.x0, g.i0, g.i1, coalesce(r.v, 0.0) AS v FROM grid g LEFT JOIN raw r USING (x0, i0, i1))"""
CNT = EVT + """,
cnt AS (SELECT g.i0, g.i1, coalesce(r.n, 0)::DOUBLE AS v FROM (SELECT DISTINCT i0, i1 FROM grid) g
  LEFT JOIN (SELECT date_diff('day', d0, ts::DATE) AS i0, hour(ts) AS i1, count(*) AS n FROM events, days GROUP BY ALL) r USING (i0, i1))"""
LIN = """lin AS (SELECT g.i0, g.i1, g.i2, coalesce(r.v, 0.0)::DOUBLE AS v
  FROM (SELECT a.i0::BIGINT AS i0, b.i1::BIGINT AS i1, c.i2::BIGINT AS i2 FROM unnest(range(0, 7)) AS a(i0), unnest(range(0, 12)) AS b(i1), unnest(range(0, 8)) AS c(i2)) g
  LEFT JOIN (SELECT l_linenumber - 1 AS i0, month(l_shipdate) - 1 AS i1, l_suppkey % 8 AS i2, sum(l_quantity) AS v FROM lineitem GROUP BY ALL) r USING (i0, i1, i2))"""
LINC = LIN + """,
linc AS (SELECT i0, i1, i2, v AS re, ((i0 + 2 * i1 + 3 * i2) % 5)::DOUBLE AS im FROM lin)"""


def dft(name: str, source: str, axis: str, keys: list[str], n: str, sign: int, real: bool = False, half: bool = False, scale: str = "1.0") -> str:
    """A CTE with the transform of ``source`` along one axis: sums of re, im times exp(sign 2 pi i j k / n)."""
    key = "".join(f"s.{k}, " for k in keys)
    top = f"({n}) // 2 + 1" if half else n
    c, d = f"cos(2 * pi() * ((s.{axis} * f.k) % ({n})) / ({n}))", f"{sign} * sin(2 * pi() * ((s.{axis} * f.k) % ({n})) / ({n}))"
    re, im = (f"s.v * {c}", f"s.v * {d}") if real else (f"s.re * {c} - s.im * {d}", f"s.im * {c} + s.re * {d}")
    return f"{name} AS (SELECT {key}f.k::BIGINT AS {axis}, sum({re}) * {scale} AS re, sum({im}) * {scale} AS im FROM {source} s, unnest(range(0, {top})) AS f(k) GROUP BY {key}f.k)"


def c2r_sql(name: str, source: str, axis: str, keys: list[str], n: str, sign: int = 1, scale: str = "1.0") -> str:
    """A CTE with the raw real transform of a half spectrum."""
    key = "".join(f"s.{k}, " for k in keys)
    t = f"2 * pi() * ((s.{axis} * f.k) % ({n})) / ({n})"
    twice = f"CASE WHEN s.{axis} = 0 OR 2 * s.{axis} = ({n}) THEN 1.0 ELSE 2.0 END"
    return f"{name} AS (SELECT {key}f.k::BIGINT AS {axis}, sum({twice} * (s.re * cos({t}) - {sign} * s.im * sin({t}) * (CASE WHEN s.{axis} = 0 OR 2 * s.{axis} = ({n}) THEN 0 ELSE 1 END))) * {scale} AS v FROM {source} s, unnest(range(0, {n})) AS f(k) GROUP BY {key}f.k)"


def r2r_sql(name: str, source: str, axis: str, keys: list[str], n: int, kind: str, values: list[str] = ("v",), scale: str = "1.0") -> str:
    """A CTE with a real-to-real kind, by its defining sum."""
    j, k = f"s.{axis}", "f.k"
    weight = {
        "dct1": f"CASE WHEN {j} = 0 THEN 1.0 WHEN {j} = {n - 1} THEN cos(pi() * {k}) ELSE 2 * cos(pi() * {j} * {k} / {max(1, n - 1)}) END",
        "dct2": f"2 * cos(pi() * ({j} + 0.5) * {k} / {n})",
        "dct3": f"CASE WHEN {j} = 0 THEN 1.0 ELSE 2 * cos(pi() * {j} * ({k} + 0.5) / {n}) END",
        "dct4": f"2 * cos(pi() * ({j} + 0.5) * ({k} + 0.5) / {n})",
        "dst1": f"2 * sin(pi() * ({j} + 1) * ({k} + 1) / {n + 1})",
        "dst2": f"2 * sin(pi() * ({j} + 0.5) * ({k} + 1) / {n})",
        "dst3": f"CASE WHEN {j} = {n - 1} THEN cos(pi() * {k}) ELSE 2 * sin(pi() * ({j} + 1) * ({k} + 0.5) / {n}) END",
        "dst4": f"2 * sin(pi() * ({j} + 0.5) * ({k} + 0.5) / {n})",
        "dht": f"(cos(2 * pi() * (({j} * {k}) % {n}) / {n}) + sin(2 * pi() * (({j} * {k}) % {n}) / {n}))",
    }[kind]
    key = "".join(f"s.{x}, " for x in keys)
    sums = ", ".join(f"sum(s.{v} * ({weight})) * {scale} AS {v}" for v in values)
    return f"{name} AS (SELECT {key}f.k::BIGINT AS {axis}, {sums} FROM {source} s, unnest(range(0, {n})) AS f(k) GROUP BY {key}f.k)"


def final(source: str, coords: list[str], values: list[str], digits: int = 6) -> str:
    return f"SELECT {', '.join(coords)}, {', '.join(f'round({v}, {digits}) + 0.0 AS {v}' for v in values)} FROM {source}"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


E2, E3 = ["i0", "i1"], ["i0", "i1", "i2"]
X3 = ["x0", "i0", "i1"]
NV, ND = "(SELECT max(vec_id) + 1 FROM embeddings)", "(SELECT max(len(embedding)) FROM embeddings)"
NE = "(SELECT n FROM days)"
C = ["re", "im"]


def lin_complex(spark: SparkSession, sf_dir: str) -> NDArray:
    """Whole parts, so that no value divided by 672 lies halfway between two rounded ones."""
    a = tables.lin(spark, sf_dir)
    return a.with_df(a.df.select(*a.coords, F.col("v").alias("re"), ((F.col("i0") + 2 * F.col("i1") + 3 * F.col("i2")) % 5).cast("double").alias("im")), dtype="c128")


# layout and construction


@query(with_(EMB, final("emb", E2, ["v"])))
def q_from_table_emb(spark, sf):
    return rounded(tables.emb(spark, sf))


@query(with_(EVT, final("evt", X3, ["v"])))
def q_from_table_evt(spark, sf):
    return rounded(tables.evt(spark, sf))


@query(with_(EMB, "SELECT i0, i1, round(v + i0 * 100 + i1, 6) + 0.0 AS v FROM emb"))
def q_from_fn_grid(spark, sf):
    """A grid of the embeddings' extents, added to them."""
    a = tables.emb(spark, sf)
    grid = NDArray.from_fn(spark, a.layout, lambda c: c["i0"] * 100 + c["i1"])
    return rounded(pointwise.pointwise2(a, grid, lambda x, y: x + y))


@query(with_(EMB, "SELECT i0, i1, round(2.5 * v, 6) + 0.0 AS v FROM emb"))
def q_from_elem_fill(spark, sf):
    a = tables.emb(spark, sf)
    return rounded(pointwise.pointwise2(a, NDArray.from_elem(spark, a.layout, 2.5), lambda x, y: x * y))


@query("SELECT l_suppkey, n AS length, m AS parts, c::BIGINT AS coord, (n * c // m)::BIGINT AS first, (n * (c + 1) // m)::BIGINT AS last FROM (SELECT l_suppkey, count(*) AS n, max(l_linenumber)::BIGINT AS m FROM lineitem GROUP BY l_suppkey), unnest(range(0, m)) AS u(c)")
def q_partition_ranges(spark, sf):
    """Each supplier's lines dealt to as many blocks as its longest order has lines."""
    cases = tables.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("length"), F.max("l_linenumber").cast("long").alias("parts"))
    cases = cases.select("*", F.explode(F.sequence(F.expr("0L"), F.col("parts") - 1)).alias("coord"))
    first, last = range_of(F.col("length"), F.col("parts"), F.col("coord"))
    return cases.select("l_suppkey", "length", "parts", "coord", first.alias("first"), last.alias("last"))


@query("SELECT l_orderkey, l_linenumber, p.n AS length, c.n AS block, count(*) AS lines FROM lineitem, (SELECT max(l_orderkey) + 1 AS n FROM lineitem) p, unnest(range(0, 8)) c(n) WHERE c.n < l_linenumber AND l_orderkey >= p.n * c.n // l_linenumber AND l_orderkey < p.n * (c.n + 1) // l_linenumber GROUP BY ALL")
def q_block_of_index(spark, sf):
    """The block of each line's order if orders were dealt to as many blocks as the line's number."""
    lines = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    length = lines.agg(F.max("l_orderkey")).first()[0] + 1
    placed = lines.withColumns({"length": F.lit(length).cast("long"), "parts": F.col("l_linenumber").cast("long")})
    return placed.groupBy("l_orderkey", "l_linenumber", "length", block_of(F.col("l_orderkey").cast("long"), F.col("length"), F.col("parts")).alias("block")).agg(F.count(F.lit(1)).alias("lines"))


@query(with_(LIN, "SELECT i0, i1, i2, ((i0 * 12 + i1) * 8 + i2)::BIGINT AS row_major, ((i2 * 7 + i0) * 12 + i1)::BIGINT AS permuted FROM lin"))
def q_row_major_offsets(spark, sf):
    a = tables.lin(spark, sf)
    b = a.with_df(a.df, layout=a.layout.with_permutation((2, 0, 1)))
    return a.df.select(*a.coords, a.linear().alias("row_major"), b.physical().alias("permuted"))


@query(with_(LIN, "SELECT ((i2 * 12 + i1) * 7 + i0)::BIGINT AS position, v FROM lin"))
def q_permute_memory_order(spark, sf):
    a = tables.lin(spark, sf)
    b = exchange.LocalTranspose(a.layout, a.layout.with_permutation((2, 1, 0)))
    return b.ordered(a).select(b.apply(a).physical().alias("position"), "v")


def _block(i: str, n: int, p: int) -> str:
    return f"((({i} + 1) * {p} - 1) // {n})"


@query(with_(LIN, f"SELECT ({_block('i0', 7, 2)} * 3 + {_block('i1', 12, 3)})::BIGINT AS block, min(i0) AS i0_first, max(i0) + 1 AS i0_last, min(i1) AS i1_first, max(i1) + 1 AS i1_last, count(*) AS cells, sum(v) AS total FROM lin GROUP BY 1"))
def q_block_ownership(spark, sf):
    a = tables.lin(spark, sf, grid=(2, 3))
    ends = [x for k in (0, 1) for x in (F.min(f"i{k}").alias(f"i{k}_first"), (F.max(f"i{k}") + 1).alias(f"i{k}_last"))]
    return a.with_block().groupBy("block").agg(*ends, F.count(F.lit(1)).alias("cells"), F.sum("v").alias("total"))


@query(with_(LIN, "SELECT i0, i1, i2, v FROM lin WHERE i0 = 3 AND i1 = 5 AND i2 = 2"))
def q_get_global_point(spark, sf):
    return tables.lin(spark, sf).at((3, 5, 2))


@query(with_(EVT, "SELECT x0, i0, i1, i0 * 0.5::DOUBLE AS c0, i1 / 24.0::DOUBLE AS c1, v FROM evt"))
def q_local_grid_coords(spark, sf):
    a = tables.evt(spark, sf)
    days = spark.range(a.shape[0]).select("id", (F.col("id") * 0.5).alias("c"))
    hours = spark.range(24).select("id", (F.col("id") / 24.0).alias("c"))
    return a.local_grid([days, hours])


# redistribution


@query(with_(LIN, "SELECT i0, i1, i2, v FROM lin"))
def q_local_transpose(spark, sf):
    a = tables.lin(spark, sf)
    return exchange.LocalTranspose(a.layout, a.layout.with_permutation((1, 2, 0))).ordered(a)


@query(with_(LIN, f"SELECT i0, i1, i2, v, ({_block('i2', 8, 2)} * 3 + {_block('i1', 12, 3)})::BIGINT AS block FROM lin"))
def q_transpose_redistribute(spark, sf):
    a = tables.lin(spark, sf, grid=(2, 3))
    return exchange.Transpose(a.layout, a.layout.with_decomposition((2, 1))).materialise(a).select(*a.coords, "v", "block")


def _remap(name: str, signs: tuple[int, ...], offsets: tuple[int, ...]) -> None:
    back = [f"(((({s} * t.i{k} + {o}) % {n}) + {n}) % {n})" for k, (s, o, n) in enumerate(zip(signs, offsets, (7, 12, 8), strict=True))]
    sql = with_(LIN, f"SELECT t.i0, t.i1, t.i2, s.v FROM lin t JOIN lin s ON s.i0 = {back[0]} AND s.i1 = {back[1]} AND s.i2 = {back[2]}")
    query(sql, name)(lambda spark, sf: exchange.remap(tables.lin(spark, sf), signs, offsets).table())


_remap("remap_reverse", (-1, -1, -1), (6, 11, 7))
_remap("remap_shift", (1, 1, 1), (3, -5, 100))
_remap("remap_mixed_signs", (-1, 1, -1), (0, 4, -9))


# pointwise


@query(with_(CNT, "SELECT e.x0, e.i0, e.i1, round(e.v * 2 - c.v, 6) + 0.0 AS v FROM evt e JOIN cnt c USING (i0, i1)"))
def q_pointwise2_broadcast(spark, sf):
    return rounded(pointwise.pointwise2(tables.evt(spark, sf), tables.evt_counts(spark, sf), lambda a, b: a * 2 - b))


@query(with_(LIN, "SELECT a.i0, a.i1, a.i2, a.v * b.v + 1 AS v FROM lin a JOIN lin b ON b.i0 = a.i0 AND b.i1 = 11 - a.i1 AND b.i2 = a.i2"))
def q_pointwise2(spark, sf):
    a = tables.lin(spark, sf)
    return pointwise.pointwise2(a, exchange.remap(a, (1, -1, 1), (0, 11, 0)), lambda x, y: x * y + 1).table()


@query(ORACLE["pointwise2_broadcast"])
def q_pointwise2_in_place(spark, sf):
    return rounded(pointwise.pointwise_in_place(tables.evt(spark, sf), [tables.evt_counts(spark, sf)], lambda a, b: a * 2 - b))


@query(with_(LIN, "SELECT a.i0, a.i1, a.i2, a.v + 2 * b.v - c.v AS v FROM lin a JOIN lin b ON b.i0 = a.i0 AND b.i1 = 11 - a.i1 AND b.i2 = a.i2 JOIN lin c ON c.i0 = 6 - a.i0 AND c.i1 = a.i1 AND c.i2 = a.i2"))
def q_pointwise3(spark, sf):
    a = tables.lin(spark, sf)
    return pointwise.pointwise3(a, exchange.remap(a, (1, -1, 1), (0, 11, 0)), exchange.remap(a, (-1, 1, 1), (6, 0, 0)), lambda x, y, z: x + 2 * y - z).table()


@query(ORACLE["pointwise3"])
def q_pointwise3_in_place(spark, sf):
    a = tables.lin(spark, sf)
    return pointwise.pointwise_in_place(a, [exchange.remap(a, (1, -1, 1), (0, 11, 0)), exchange.remap(a, (-1, 1, 1), (6, 0, 0))], lambda x, y, z: x + 2 * y - z).table()


def _three(spark, sf) -> list[NDArray]:
    a = tables.lin(spark, sf)
    return [a, exchange.remap(a, (1, -1, 1), (0, 11, 0)), exchange.remap(a, (-1, 1, 1), (6, 0, 0))]


THREE = LIN + """,
three AS (SELECT a.i0, a.i1, a.i2, a.v AS a, b.v AS b, c.v AS c FROM lin a JOIN lin b ON b.i0 = a.i0 AND b.i1 = 11 - a.i1 AND b.i2 = a.i2
  JOIN lin c ON c.i0 = 6 - a.i0 AND c.i1 = a.i1 AND c.i2 = a.i2)"""


@query(with_(THREE, "SELECT i0, i1, i2, greatest(a, b, c) AS v FROM three"))
def q_pointwise_many(spark, sf):
    return pointwise.pointwise_many(_three(spark, sf), F.array_max).table()


@query(with_(THREE, "SELECT i0, i1, i2, a - b - c AS v FROM three"))
def q_pointwise_many_in_place(spark, sf):
    a, *rest = _three(spark, sf)
    return pointwise.pointwise_many_in_place(a, rest, lambda v: v[0] - v[1] - v[2]).table()


# reductions


@query(with_(LIN, "SELECT sum(v)::BIGINT AS value FROM lin"))
def q_global_sum_int(spark, sf):
    return reduce.global_sum(tables.lin(spark, sf, "i64", (2, 3)))


@query(with_(LIN, "SELECT sum(v)::BIGINT AS value FROM lin"))
def q_global_sum_int_total(spark, sf):
    return reduce.global_sum(tables.lin(spark, sf, "i64"), checked="total")


def _reduction(name: str, source: str, value: str, f: Callable[[NDArray], DataFrame], load=None, table_: str = "evt") -> None:
    load = load or tables.evt
    query(with_(source, f"SELECT round({value}, 6) + 0.0 AS value FROM {table_}"), name)(lambda spark, sf: one(f(load(spark, sf))))


_reduction("global_sum_float", EMB, "sum(v)", reduce.global_sum, tables.emb, "emb")
_reduction("global_min", EMB, "min(v)", reduce.global_min, tables.emb, "emb")
_reduction("global_max", EMB, "max(v)", reduce.global_max, tables.emb, "emb")
_reduction("l2_norm", EMB, "sqrt(sum(v * v))", reduce.l2_norm, tables.emb, "emb")
_reduction("l2_norm_complex", EMBC, "sqrt(sum(re * re + im * im))", reduce.l2_norm, tables.emb_complex, "embc")
_reduction("sum_by", EVT, "sum(v * v + 1)", lambda a: reduce.sum_by(a, lambda v: v * v + 1))
_reduction("norm_by", EVT, "sqrt(sum((v - 3) * (v - 3)))", lambda a: reduce.norm_by(a, lambda v: v - 3))
_reduction("min_by", EVT, "min(abs(v - 50))", lambda a: reduce.min_by(a, lambda v: F.abs(v - 50)))
_reduction("max_by", EVT, "max(-v)", lambda a: reduce.max_by(a, lambda v: -v))


@query(with_(EMBC, "SELECT {'re': round(sum(re), 6) + 0.0, 'im': round(sum(im), 6) + 0.0}.re AS re, round(sum(im), 6) + 0.0 AS im FROM embc"))
def q_global_sum_complex(spark, sf):
    v = reduce.global_sum(tables.emb_complex(spark, sf))
    return v.select(*[(F.round(f"value.{c}", 6) + F.lit(0.0)).alias(c) for c in C])


@query(with_(EVT, "SELECT bool_or(v <> 0) AS value FROM evt"), "any")
def q_any(spark, sf):
    return reduce.any_(tables.evt(spark, sf))


@query(with_(EVT, "SELECT bool_and(v <> 0) AS value FROM evt"), "all")
def q_all(spark, sf):
    return reduce.all_(tables.evt(spark, sf))


@query(with_(EVT, "SELECT bool_or(v > 100000) AS value FROM evt"))
def q_any_by(spark, sf):
    return reduce.any_by(tables.evt(spark, sf), lambda v: v > 100000)


@query(with_(EVT, "SELECT bool_and(v >= 0) AS value FROM evt"))
def q_all_by(spark, sf):
    return reduce.all_by(tables.evt(spark, sf), lambda v: v >= 0)


_ZIP = ORACLE["pointwise2_broadcast"].rsplit("\nSELECT", 1)[0]


@query(_ZIP + "\nSELECT round(sum(e.v * c.v), 4) + 0.0 AS value FROM evt e JOIN cnt c USING (i0, i1)")
def q_zip_sum_by(spark, sf):
    return one(reduce.zip_sum_by(tables.evt(spark, sf), tables.evt_counts(spark, sf), lambda a, b: a * b), 4)


@query(_ZIP + "\nSELECT round(sqrt(sum((e.v - c.v) * (e.v - c.v))), 6) + 0.0 AS value FROM evt e JOIN cnt c USING (i0, i1)")
def q_zip_norm_by(spark, sf):
    return one(reduce.zip_norm_by(tables.evt(spark, sf), tables.evt_counts(spark, sf), lambda a, b: a - b))


@query(_ZIP + "\nSELECT round(greatest(0, max(e.v - c.v)), 6) + 0.0 AS value FROM evt e JOIN cnt c USING (i0, i1)")
def q_map_reduce2(spark, sf):
    return one(reduce.map_reduce([tables.evt(spark, sf), tables.evt_counts(spark, sf)], 0.0, lambda a, b: a - b, F.greatest))


@query(with_(THREE, "SELECT sum(a * b - c) AS value FROM three"))
def q_map_reduce3(spark, sf):
    return reduce.map_reduce(_three(spark, sf), 0.0, lambda a, b, c: a * b - c, "sum")


@query(with_(THREE, "SELECT sum(a + b + c)::DOUBLE AS value FROM three"))
def q_map_reduce_many(spark, sf):
    return reduce.map_reduce_many(_three(spark, sf), 0.0, lambda v: v[0] + v[1] + v[2], lambda x, y: x + y)


@query(with_(THREE, "SELECT sum(a * b + c) AS value FROM three"))
def q_sum_many_by(spark, sf):
    return reduce.sum_many_by(_three(spark, sf), lambda v: v[0] * v[1] + v[2])


@query(with_(THREE, "SELECT round(sqrt(sum((a - b + c) * (a - b + c))), 6) + 0.0 AS value FROM three"))
def q_norm_many_by(spark, sf):
    return one(reduce.norm_many_by(_three(spark, sf), lambda v: v[0] - v[1] + v[2]))


@query(with_(THREE, "SELECT min(a + b - c) AS value FROM three"))
def q_min_many_by(spark, sf):
    return reduce.min_many_by(_three(spark, sf), lambda v: v[0] + v[1] - v[2])


@query(with_(THREE, "SELECT max(a + b - c) AS value FROM three"))
def q_max_many_by(spark, sf):
    return reduce.max_many_by(_three(spark, sf), lambda v: v[0] + v[1] - v[2])


@query(with_(EVT, "SELECT x0, i0, i1, round(v, 6) + 0.0 AS v, ((x0 * (SELECT n FROM days) + i0) * 24 + i1)::BIGINT AS \"offset\" FROM evt"))
def q_gather(spark, sf):
    return reduce.gather(tables.evt(spark, sf)).withColumn("v", F.round("v", 6) + F.lit(0.0))


# transforms


@query(with_(EMBC, dft("a", "embc", "i1", ["i0"], ND, -1), dft("b", "a", "i0", ["i1"], NV, -1), final("b", E2, C)))
def q_c2c_forward(spark, sf):
    a = tables.emb_complex(spark, sf)
    return rounded(C2c.like(a).forward(a))


@query(with_(EMBC, dft("a", "embc", "i1", ["i0"], ND, -1), final("a", E2, C)))
def q_c2c_forward_1axis(spark, sf):
    a = tables.emb_complex(spark, sf)
    return rounded(C2c.like(a, axes=[1]).forward(a))


@query(with_(LINC, dft("a", "linc", "i2", E2, "8", 1), dft("b", "a", "i1", ["i0", "i2"], "12", 1), dft("c", "b", "i0", ["i1", "i2"], "7", 1, scale="1.0 / 672"), final("c", E3, C)))
def q_c2c_inverse(spark, sf):
    a = lin_complex(spark, sf)
    return rounded(C2c.like(a).inverse(a))


@query(with_(LINC, dft("a", "linc", "i2", E2, "8", 1), dft("b", "a", "i1", ["i0", "i2"], "12", 1), dft("c", "b", "i0", ["i1", "i2"], "7", 1), final("c", E3, C)))
def q_c2c_backward(spark, sf):
    a = lin_complex(spark, sf)
    return rounded(C2c.like(a).backward(a))


@query(with_(LINC, dft("a", "linc", "i2", E2, "8", -1), dft("c", "a", "i0", ["i1", "i2"], "7", -1), final("c", E3, C)))
def q_c2c_partial_axes(spark, sf):
    a = lin_complex(spark, sf)
    return rounded(C2c.like(a, axes=[2, 0]).forward(a))


@query(with_(LINC, dft("a", "linc", "i2", E2, "8", 1), dft("b", "a", "i1", ["i0", "i2"], "12", -1), dft("c", "b", "i0", ["i1", "i2"], "7", 1), final("c", E3, C)))
def q_c2c_directions(spark, sf):
    a = lin_complex(spark, sf)
    return rounded(C2c.like(a, directions=(BACKWARD, FORWARD, BACKWARD)).forward(a))


@query(with_(EVT, dft("a", "evt", "i1", ["x0", "i0"], "24", -1, real=True, half=True), dft("b", "a", "i0", ["x0", "i1"], NE, -1), final("b", X3, C)))
def q_r2c_forward(spark, sf):
    a = tables.evt(spark, sf)
    return rounded(R2c.like(a).forward(a))


def _r2c_there_and_back(spark, sf, how: str) -> DataFrame:
    a = tables.evt(spark, sf)
    plan = R2c.like(a)
    return rounded(getattr(plan, how)(plan.forward(a)))


_SPECTRUM = (EVT, dft("a", "evt", "i1", ["x0", "i0"], "24", -1, real=True, half=True), dft("b", "a", "i0", ["x0", "i1"], NE, -1), dft("c", "b", "i0", ["x0", "i1"], NE, 1))


@query(with_(*_SPECTRUM, c2r_sql("d", "c", "i1", ["x0", "i0"], "24", scale=f"1.0 / (24 * {NE})"), final("d", X3, ["v"], 5)))
def q_r2c_inverse(spark, sf):
    return _r2c_there_and_back(spark, sf, "inverse").withColumn("v", F.round("v", 5) + F.lit(0.0))


@query(with_(*_SPECTRUM, c2r_sql("d", "c", "i1", ["x0", "i0"], "24"), final("d", X3, ["v"], 3)))
def q_r2c_backward(spark, sf):
    return _r2c_there_and_back(spark, sf, "backward").withColumn("v", F.round("v", 3) + F.lit(0.0))


def _c2r_input(spark, sf) -> tuple[C2r, NDArray]:
    """A half spectrum of LIN along axis 0 with real planes where they must be."""
    a = tables.lin(spark, sf)
    plan = C2r.like(a, axes=[0, 2])
    return plan, plan.backward(a)


_HALF = (LIN, dft("a", "lin", "i0", ["i1", "i2"], "7", -1, real=True, half=True), dft("b", "a", "i2", E2, "8", -1))


@query(with_(*_HALF, final("b", E3, C)))
def q_c2r_backward(spark, sf):
    return rounded(_c2r_input(spark, sf)[1])


@query(with_(*_HALF[:2], dft("b", "a", "i2", E2, "8", -1, scale="1.0 / 56"), final("b", E3, C)))
def q_c2r_inverse(spark, sf):
    a = tables.lin(spark, sf)
    return rounded(C2r.like(a, axes=[0, 2]).inverse(a))


@query(with_(*_HALF, dft("c", "b", "i2", E2, "8", 1), c2r_sql("d", "c", "i0", ["i1", "i2"], "7"), final("d", E3, ["v"], 4)))
def q_c2r_forward(spark, sf):
    plan, half = _c2r_input(spark, sf)
    return rounded(plan.forward(half), 4)


def _kinds(name: str, kind: str) -> None:
    n = 12
    query(with_(LIN, r2r_sql("a", "lin", "i1", ["i0", "i2"], n, kind), final("a", E3, ["v"])), name)(lambda spark, sf: rounded((lambda a: R2r.like(a, (None, kind, None)).forward(a))(tables.lin(spark, sf))))
    back = with_(LIN, r2r_sql("a", "lin", "i1", ["i0", "i2"], n, REVERSE[kind], scale=f"1.0 / {factor(kind, n)}"), final("a", E3, ["v"]))
    query(back, f"{name}_inverse")(lambda spark, sf: rounded((lambda a: R2r.like(a, (None, kind, None)).inverse(a))(tables.lin(spark, sf))))


for _kind in R2R_KINDS:
    _kinds(f"r2r_{_kind}", _kind)


@query(with_(LINC, r2r_sql("a", "linc", "i2", E2, 8, "dst2", C), r2r_sql("b", "a", "i0", ["i1", "i2"], 7, "dct1", C), final("b", E3, C)))
def q_r2r_complex_axes(spark, sf):
    a = lin_complex(spark, sf)
    return rounded(R2r.like(a, ("dct1", None, "dst2")).forward(a))


@query(with_(EVT, r2r_sql("a", "evt", "i1", ["x0", "i0"], 24, "dht"), final("a", X3, ["v"])))
def q_dht_forward(spark, sf):
    a = tables.evt(spark, sf)
    return rounded(Dht.like(a, axes=[1]).forward(a))


@query(with_(LIN, r2r_sql("a", "lin", "i2", E2, 8, "dht"), r2r_sql("b", "a", "i1", ["i0", "i2"], 12, "dht"), r2r_sql("c", "b", "i0", ["i1", "i2"], 7, "dht", scale="1.0 / 672"), final("c", E3, ["v"])))
def q_dht_inverse(spark, sf):
    a = tables.lin(spark, sf)
    return rounded(Dht.like(a).inverse(a))


@query(with_(LINC, r2r_sql("a", "linc", "i2", E2, 8, "dht", C), r2r_sql("b", "a", "i1", ["i0", "i2"], 12, "dct2", C), dft("c", "b", "i0", ["i1", "i2"], "7", -1), final("c", E3, C)))
def q_mixed_c2c(spark, sf):
    a = lin_complex(spark, sf)
    return rounded(MixedC2c.like(a, ("fft", "dct2", "dht")).forward(a))


@query(with_(LINC, dft("a", "linc", "i0", ["i1", "i2"], "7", 1), r2r_sql("b", "a", "i1", ["i0", "i2"], 12, "dct3", C), r2r_sql("c", "b", "i2", E2, 8, "dht", C, scale="1.0 / 1344"), final("c", E3, C)))
def q_mixed_c2c_inverse(spark, sf):
    a = lin_complex(spark, sf)
    return rounded(MixedC2c.like(a, ("fft", "dct2", "dht")).inverse(a))


@query(with_(LIN, r2r_sql("a", "lin", "i2", E2, 8, "dht"), dft("b", "a", "i1", ["i0", "i2"], "12", -1, real=True, half=True), dft("c", "b", "i0", ["i1", "i2"], "7", 1), final("c", E3, C)))
def q_mixed_r2c(spark, sf):
    a = tables.lin(spark, sf)
    return rounded(MixedR2c.like(a, ("fft", "rfft", "dht"), directions=(BACKWARD, FORWARD, FORWARD)).forward(a))


@query(with_(LIN, final("lin", E3, ["v"])))
def q_mixed_r2c_round_trip(spark, sf):
    a = tables.lin(spark, sf)
    plan = MixedR2c.like(a, ("dct4", "rfft", "dst1"))
    return rounded(plan.inverse(plan.forward(a)))


@query(
    with_(
        LINC,
        "m AS (SELECT 0::BIGINT AS x0, * FROM linc UNION ALL SELECT 1::BIGINT AS x0, i0, i1, i2, 2 * re AS re, -im AS im FROM linc)",
        dft("a", "m", "i2", ["x0", "i0", "i1"], "8", -1),
        dft("b", "a", "i1", ["x0", "i0", "i2"], "12", -1),
        final("b", ["x0", *E3], C),
    )
)
def q_collection_forward_many(spark, sf):
    a = lin_complex(spark, sf)
    b = a.with_df(a.df.select(*a.coords, (2 * F.col("re")).alias("re"), (-F.col("im")).alias("im")))
    out = C2c.like(a, axes=[1, 2]).forward_many([a, b])
    parts = [rounded(x).withColumn("x0", F.lit(m).cast("long")) for m, x in enumerate(out)]
    return parts[0].unionByName(parts[1])


def _two_members(spark, sf) -> list[NDArray]:
    a = lin_complex(spark, sf)
    return [a, a.with_df(a.df.select(*a.coords, (2 * F.col("re")).alias("re"), (-F.col("im")).alias("im")))]


_MEMBERS = (LINC, "m AS (SELECT 0::BIGINT AS x0, * FROM linc UNION ALL SELECT 1::BIGINT AS x0, i0, i1, i2, 2 * re AS re, -im AS im FROM linc)")


@query(with_(*_MEMBERS, dft("a", "m", "i2", ["x0", "i0", "i1"], "8", 1), dft("b", "a", "i1", ["x0", "i0", "i2"], "12", 1, scale="1.0 / 96"), final("b", ["x0", *E3], C)))
def q_collection_inverse_many(spark, sf):
    """All members in one job."""
    pair = _two_members(spark, sf)
    return rounded(C2c.like(pair[0], axes=[1, 2]).stacked(pair, "inverse"))


@query(with_(*_MEMBERS, dft("a", "m", "i2", ["x0", "i0", "i1"], "8", 1), dft("b", "a", "i1", ["x0", "i0", "i2"], "12", 1), final("b", ["x0", *E3], C)))
def q_collection_backward_many(spark, sf):
    pair = _two_members(spark, sf)
    parts = [rounded(x).withColumn("x0", F.lit(m).cast("long")) for m, x in enumerate(C2c.like(pair[0], axes=[1, 2]).backward_many(pair))]
    return parts[0].unionByName(parts[1])


@query(with_(EVT, "p AS (SELECT x0, i0, f.k::BIGINT AS i1, sum(v * CASE WHEN f.k = 12 AND i1 % 2 = 1 THEN -1 ELSE 1 END) AS e FROM evt, (VALUES (0), (12)) AS f(k) GROUP BY x0, i0, f.k)", "SELECT x0, i1, round(sqrt(sum(e * e)), 3) + 0.0 AS norm, true AS passes FROM p GROUP BY x0, i1"))
def q_endpoint_check(spark, sf):
    """The planes that must be real, of each batch of a half spectrum of real lines, with the verdict on each."""
    a = tables.evt(spark, sf)
    half = R2c.like(a, [1]).forward(a)
    planes = plane_norms(half, 1, 24)
    return planes.select("x0", "i1", (F.round("re", 3) + F.lit(0.0)).alias("norm"), is_real(0.0, 128 * 2.0**-52).alias("passes"))


@query(with_(EMBC, dft("a", "embc", "i1", ["i0"], ND, -1), "SELECT i0, round(sum(re * re + im * im) / " + ND + ", 6) + 0.0 AS energy FROM a GROUP BY i0"))
def q_c2c_parseval(spark, sf):
    a = tables.emb_complex(spark, sf)
    out = C2c.like(a, axes=[1]).forward(a)
    return out.df.groupBy("i0").agg((F.round(F.sum(F.col("re") ** 2 + F.col("im") ** 2) / a.shape[1], 6) + F.lit(0.0)).alias("energy"))


# files


def _folder(spark: SparkSession) -> str:
    """A new folder of this query in the shared folder of the cluster, or in local mode a temporary one.

    It is the application's own, and goes when the application ends; what reads it lazily must have run by then.
    """
    base = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _scratch()
    if "://" in base:
        raise RuntimeError("array files need a mounted folder in spark.checkpoint.dir; the Parquet store doesn't")
    path = f"{base}/arrays-{uuid.uuid4().hex}"
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, True)
    return path


@functools.cache
def _scratch() -> str:
    path = tempfile.mkdtemp(prefix="weftspark-files-")
    atexit.register(shutil.rmtree, path, True)
    return path


@query(with_(LIN, "SELECT i0, i1, i2, v FROM lin"))
def q_raw_read(spark, sf):
    a, path = tables.lin(spark, sf), f"{_folder(spark)}/raw"
    files.write_raw(path, a)
    return files.read_raw(spark, path, a.layout).table()


@query(with_(EMBC, "SELECT i0, i1, re, im FROM embc"))
def q_binary_roundtrip(spark, sf):
    a, path = tables.emb_complex(spark, sf), f"{_folder(spark)}/array"
    files.write_array(path, a)
    return files.read_array(spark, path, a.layout, (), "c128").table()


@query(with_(LIN, "SELECT 0::BIGINT AS member, i0, i1, i2, v FROM lin UNION ALL SELECT 1::BIGINT, i0, i1, i2, -v FROM lin"))
def q_named_append_read(spark, sf):
    a, path = tables.lin(spark, sf), f"{_folder(spark)}/named"
    files.write_named(path, "first", a)
    files.append_named(path, "second/part", a.with_df(a.df.withColumn("v", -F.col("v"))))
    out = [files.read_named(spark, path, n, a.layout).table().withColumn("member", F.lit(m).cast("long")) for m, n in enumerate(("first", "second/part"))]
    return out[0].unionByName(out[1])


@query(with_(LIN, "SELECT i0, i1, i2, v FROM lin"))
def q_chunked_roundtrip(spark, sf):
    a = tables.lin(spark, sf, grid=(2, 3))
    a = a.with_df(a.df, layout=a.layout.with_permutation((2, 0, 1)))
    path = f"{_folder(spark)}/blocks"
    files.write_chunked(path, a)
    return files.read_chunked(spark, path, a.layout).table()


@query(with_(EVT, "SELECT 0::BIGINT AS member, x0, i0, i1, v FROM evt UNION ALL SELECT 1::BIGINT, x0, i0, i1, 2 * v FROM evt"), "collection_roundtrip")
def q_collection_roundtrip(spark, sf):
    a, path = tables.evt(spark, sf), f"{_folder(spark)}/members"
    files.write_collection(path, [a, a.with_df(a.df.withColumn("v", 2 * F.col("v")))])
    out = [m.table().withColumn("member", F.lit(k).cast("long")) for k, m in enumerate(files.read_collection(spark, path, 2, a.layout, a.extra))]
    return out[0].unionByName(out[1])


#: The extents of EMB as text.
EMB_SHAPE = "(SELECT (max(vec_id) + 1) || ',' || max(len(embedding)) AS s FROM embeddings)"


@query(f"SELECT name, dtype, s AS shape, extra FROM (VALUES ('a', 'f64', ''), ('b', 'f32', ''), ('c', 'f64', '2')) AS t(name, dtype, extra), {EMB_SHAPE}")
def q_catalog(spark, sf):
    a, path = tables.emb(spark, sf), f"{_folder(spark)}/catalog"
    files.write_named(path, "a", a)
    files.append_named(path, "b", a.with_df(a.df.withColumn("v", F.col("v").cast("float")), dtype="f32"))
    files.append_named_collection(path, "c", [a, a])
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return files.named_catalog(spark, path).select("name", "dtype", join("global_shape").alias("shape"), join("extra_shape").alias("extra"))


@query(with_(EMB, "SELECT i0, i1, v FROM emb"))
def q_parquet_roundtrip(spark, sf):
    a, path = tables.emb(spark, sf), f"{_folder(spark)}/parquet"
    parquet.write(a, path)
    return parquet.read(spark, path).table()


__all__ = ["ORACLE", "QUERIES"]
