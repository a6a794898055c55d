"""Arrays made from the test tables; each covers its whole table.

* EMB: ``embeddings`` as [vectors, dimensions];
* EVT: ``events`` as batch [event types] x [days, hours], summed and zero-filled;
* LIN: ``lineitem`` as [line numbers, months, suppliers modulo 8], summed and zero-filled;
* ORD: ``lineitem`` as [orders, line numbers, 2] of quantity and discount, zero-filled; it grows with the table;
* OUT: ``embeddings`` as [vectors, dimensions, dimensions] of products of two dimensions; it grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.array import NDArray
from .plans.layout import Layout


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str, grid=(1,)) -> NDArray:
    """Rows are numbered by vec_id, which counts from 0 without gaps; extents come from the table."""
    rows = table(spark, sf_dir, "embeddings")
    top, width = rows.agg(F.max("vec_id"), F.max(F.size("embedding"))).first()
    cells = rows.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v"))
    return NDArray.from_dense(cells, Layout.of((top + 1, width), grid), (), "f64")


def emb_complex(spark: SparkSession, sf_dir: str) -> NDArray:
    """The same with imaginary parts: the value of the next dimension's index over 64."""
    a = emb(spark, sf_dir)
    return a.with_df(a.df.select("i0", "i1", F.col("v").alias("re"), ((F.col("i0") + F.col("i1")) % 7 / 8.0).alias("im")), dtype="c128")


def evt(spark: SparkSession, sf_dir: str) -> NDArray:
    """Sums of value; event types in name order are the batch axis."""
    rows = table(spark, sf_dir, "events")
    kinds = [r[0] for r in rows.select("event_type").distinct().orderBy("event_type").collect()]
    first, last = rows.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    days = (last - first).days + 1
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))]), F.col("event_type"))
    cells = rows.groupBy(rank.cast("long").alias("x0"), F.datediff(F.to_date("ts"), F.lit(first)).cast("long").alias("i0"), F.hour("ts").cast("long").alias("i1")).agg(F.sum("value").alias("v"))
    return NDArray.from_table(cells, Layout.of((days, 24)), (len(kinds),), "f64", fill=0.0)


def evt_counts(spark: SparkSession, sf_dir: str) -> NDArray:
    rows = table(spark, sf_dir, "events")
    first, last = rows.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    cells = rows.groupBy(F.lit(0).cast("long").alias("x0"), F.datediff(F.to_date("ts"), F.lit(first)).cast("long").alias("i0"), F.hour("ts").cast("long").alias("i1")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return NDArray.from_table(cells, Layout.of(((last - first).days + 1, 24)), (1,), "f64", fill=0.0)


def lin(spark: SparkSession, sf_dir: str, dtype: str = "f64", grid=(1,)) -> NDArray:
    """Summed quantities, which are whole numbers."""
    rows = table(spark, sf_dir, "lineitem")
    cells = rows.groupBy((F.col("l_linenumber") - 1).cast("long").alias("i0"), (F.month("l_shipdate") - 1).cast("long").alias("i1"), (F.col("l_suppkey") % 8).cast("long").alias("i2")).agg(F.sum("l_quantity").alias("v"))
    return NDArray.from_table(cells, Layout.of((7, 12, 8), grid), (), dtype, fill=0)


def ord_(spark: SparkSession, sf_dir: str) -> NDArray:
    """Order keys count the orders; the last axis is summed quantity and summed discount."""
    rows = table(spark, sf_dir, "lineitem")
    first, last, lines = rows.agg(F.min("l_orderkey"), F.max("l_orderkey"), F.max("l_linenumber")).first()
    both = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("i2"), F.col("l_quantity").cast("double").alias("v")), F.struct(F.lit(1).cast("long").alias("i2"), F.col("l_discount").cast("double").alias("v")))).alias("b")
    cells = rows.select((F.col("l_orderkey") - first).cast("long").alias("i0"), (F.col("l_linenumber") - 1).cast("long").alias("i1"), both).select("i0", "i1", "b.i2", "b.v")
    return NDArray.from_table(cells, Layout.of((last - first + 1, lines, 2)), (), "f64", fill=0.0, combine=F.sum)


def outer(spark: SparkSession, sf_dir: str) -> NDArray:
    a = emb(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "a"), "embedding")
    cells = rows.select("i0", F.col("i1").cast("long").alias("i1"), "a", F.posexplode("embedding").alias("i2", "b")).select("i0", "i1", F.col("i2").cast("long").alias("i2"), (F.col("a").cast("double") * F.col("b")).alias("v"))
    return NDArray.from_dense(cells, Layout.of((*a.shape, a.shape[1])), (), "f64")
