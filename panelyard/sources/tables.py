"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Set here only where it is unset, and then only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def erase(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own in the shared one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back: later steps neither recompute it nor depend on an executor that may be lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of durable() that nothing reads any more."""
    erase(df.sparkSession, df.written_to)


def settled(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """A small result written, and the tables of durable() that it was made from deleted."""
    out = durable(df, "result")
    for t in spent:
        discard(t)
    return out


def numbered(df: DataFrame, order: list[str | Column], out: str = "pos", total: str | None = None, twice: bool = False) -> DataFrame:
    """df with a number from 0 in an order of all its rows, and their number in column `total`; durable.

    Rows are sorted in ranges and numbered inside each; ranges are offset by the rows before them, of which
    a row a range comes together. Nulls come first. Rows that tie are numbered in any order. Finding the ranges reads df
    once more, so it is written first, unless it is durable or cheap enough to be made `twice`."""
    first = df if twice or hasattr(df, "written_to") else durable(df, "unnumbered")
    ranged = first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = durable(ranged, "numbered")
    if first is not df:
        discard(first)
    of = F.shiftright("_at", 33)
    sizes = held.groupBy(of.alias("_range")).agg(F.count("*").alias("_rows")).withColumn("_one", F.lit(0))
    w = Window.partitionBy("_one")
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", before.alias("_before"), F.sum("_rows").over(w).alias("_total"))
    # one row a range
    rows = held.withColumn("_range", of).join(F.broadcast(sizes), "_range")
    own = [*df.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(out)]
    out_ = rows.select(*own, *([F.col("_total").alias(total)] if total else []))
    out_.written_to = held.written_to
    return out_
