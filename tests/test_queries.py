"""Every registered query with SQL gives what its SQL gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftspark import queries as core
from weftspark import queries_forms  # noqa: F401  (adds to core)
from weftspark.streaming.reductions import running

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else value + 0.0
    return value


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_equals_its_sql(spark, tables, sf_dir, name):
    df = core.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = tables.execute(core.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=repr)
    assert got == want


def test_entry_point(spark):
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir("/root/testdata/sf0.001") and entry.entry(spark).limit(1).count() == 1


def test_running_reduction(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, float("inf")), (1, 1.0)], "x0 long, v double")
    cells.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x0 long, v double").parquet(str(tmp_path / "in"))
    q = running(stream, ["x0"]).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "ckpt")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["x0"]: (r["sum"], r["min"], r["max"], r["cells"]) for r in spark.table("running").collect()}
    assert got == {0: (3.0, 1.0, 2.0, 2), 1: (float("inf"), 1.0, float("inf"), 2)}
