"""Shared-folder staging and skew-safe joins used by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast after it has been counted.
BROADCAST_ROWS = 1_000_000
#: Bytes up to which it may be, where its rows have been measured.
BROADCAST_BYTES = 64 << 20

_own: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.TemporaryDirectory(prefix="weftspark-")
        atexit.register(_own["dir"].cleanup)
    return "file://" + _own["dir"].name


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/weftspark/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove all that this application has staged; DataFrames that are still to be read from it fail afterwards."""
    _remove(spark, _own_dir(spark))


#: Where the folders that are begun inside ``collecting`` are noted; each thread has its own.
_begun: ContextVar[list[str] | None] = ContextVar("begun", default=None)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """A list of the folders that this thread begins to stage meanwhile."""
    mine: list[str] = []
    before = _begun.set(mine)
    try:
        yield mine
    finally:
        _begun.reset(before)


def remove(spark: SparkSession, folders: list[str]) -> None:
    for path in folders:
        _remove(spark, path)


class Staged:
    """Tables written to the shared folder: each cuts the lineage, survives lost executors and is read back."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base, self.n = spark, f"{_own_dir(spark)}/{what}-{uuid.uuid4().hex}", 0
        if (mine := _begun.get()) is not None:
            mine.append(self.base)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete staged tables that nothing will read again."""
        for t in tables:
            _remove(self.spark, t._staged_at)


def lookup(df: DataFrame, table: DataFrame, key: str, weight: str, total: int, parts: int = 1000) -> DataFrame:
    """Left join ``df`` with ``table`` (one row per ``key``) where a few keys may hold most rows of ``df``.

    ``table[weight]`` is the number of rows of ``df`` with that key and ``total`` the number of all rows.  A key with
    at least ``total / parts`` rows is hot, so there are at most ``parts`` hot keys: these are broadcast.  The rest is
    a shuffle join in which no key has more than ``total / parts`` rows; hot rows get keys of their own there, so
    they are dealt out evenly.  ``key`` must not be null in ``df``.
    """
    bar = max(1000, total // parts)
    values = [c for c in table.columns if c not in (key, weight)]
    hot = table.filter(F.col(weight) >= bar).select(F.col(key), *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot"))
    cold = table.filter(F.col(weight) < bar).select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_spread"), *values)
    out = df.join(F.broadcast(hot), key, "left")
    out = out.withColumn("_deal", F.when(F.col("_hot"), F.xxhash64(*df.columns)).otherwise(F.lit(0).cast("long")))
    out = out.join(cold.hint("merge"), (F.col(key) == F.col("_key")) & (F.col("_deal") == F.col("_spread")), "left")
    return out.select(*df.columns, *[F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in values])


def keyed(docs: DataFrame) -> DataFrame:
    """The whole row as ``row``, and what names it: doc_id and the text's MD5."""
    return docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("string"))).alias("digest"))


def without(docs: DataFrame, gone: DataFrame, n: int) -> DataFrame:
    """``docs`` without the rows named in ``gone`` (doc_id, digest; nulls name nulls), of which ``n`` have been counted."""
    return matching(keyed(docs), gone, n, "left_anti").select("row.*")


def matching(rows: DataFrame, named: DataFrame, n: int, how: str) -> DataFrame:
    """``keyed`` rows that are (``left_semi``) or aren't (``left_anti``) in ``named``, which is broadcast if it is small."""
    side = named.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("digest").eqNullSafe(F.col("_digest"))
    return rows.join(F.broadcast(side) if n <= BROADCAST_ROWS else side.hint("merge"), on, how)


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def set_aside(df: DataFrame, name: str) -> DataFrame:
    """Rename a column called ``name`` (in any case of letters) ``input_name``, or ``input_input_name`` and so on."""
    new = f"input_{name}"
    while any(c.lower() == new.lower() for c in df.columns):
        new = f"input_{new}"
    return df.select(*[c.alias(new) if n.lower() == name.lower() else c for n, c in zip(df.columns, columns(df), strict=True)])
