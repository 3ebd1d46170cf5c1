"""Exact ranks and quantiles of cohorts of any size, with no task that holds a cohort.

Ranks come from sorted ranges: rows are sorted by cohort, value and key in ranges of about equal size, wherever cohorts begin
and end, numbered inside each range and offset; a cohort's first number is then taken off. Quantiles take a mergeable sketch as a
bracket and count: all values below a bracket are one number, those inside are counted by value, so what comes together is the narrow
bracket alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import numbered

#: The sketch's relative rank error is one in this many; the bracket reaches three times as far.
ACCURACY = 10_000


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on keys whose nulls agree; a's keys stay."""
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row
    b = b.select(*(F.col(k).alias(f"_of_{k}") if k in keys else F.col(k) for k in b.columns))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys))
    return a.join(b, same, how).drop(*(f"_of_{k}" for k in keys))


def ranked(df: DataFrame, by: list[str], order: list[str | Column], rank: str = "_rank", size: str = "_n") -> DataFrame:
    """df with its rows' ranks from 1 in an order within their cohort (nulls first, as a value), and the cohort's number of rows. Null cohorts are cohorts."""
    rows = numbered(df, [*by, *order], "_pos")
    cells = rows.groupBy(*by).agg(F.min("_pos").alias("_first"), F.count("*").alias(size))
    return null_safe(rows, cells, by).withColumn(rank, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first")


def average_ranked(df: DataFrame, by: list[str], value: str, rank: str = "_rank") -> DataFrame:
    """df with average ranks: rows that tie share the mean of their places."""
    rows = numbered(df, [*by, value], "_pos")
    cells = rows.groupBy(*by).agg(F.min("_pos").alias("_first"))
    ties = rows.groupBy(*by, value).agg(F.min("_pos").alias("_low"), F.count("*").alias("_same"))
    ties = null_safe(ties, cells, by).select(*by, value, (F.col("_low") - F.col("_first") + 1 + (F.col("_same") - 1) / 2).alias(rank))
    return null_safe(rows.drop("_pos"), ties, [*by, value])


def quantiles(df: DataFrame, value: str | Column, by: list[str], probs: list[float], out: str = "q") -> DataFrame:
    """(by..., out): an array of the exact quantiles of each cohort, linear between neighbours. Missing values are
    left out; cohorts without any have no row. df is read twice."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    reach = 3 / ACCURACY
    ends = [e for p in probs for e in (max(0.0, p - reach), min(1.0, p + reach))]
    sketch = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(ACCURACY)).alias("_e"))
    at = [F.struct(F.lit(i).alias("i"), F.col("_e")[2 * i].alias("lo"), F.col("_e")[2 * i + 1].alias("hi"), (F.lit(p) * (F.col("_n") - 1)).alias("place")) for i, p in enumerate(probs)]
    near = null_safe(rows, sketch, by).select(*by, "_v", F.explode(F.array(*at)).alias("_b"))
    # below a bracket, inside it (by value), above it
    kind = F.when(F.col("_v") < F.col("_b.lo"), 0).when(F.col("_v") <= F.col("_b.hi"), 1).otherwise(2)
    near = near.select(*by, F.col("_b.i").alias("_i"), F.col("_b.place").alias("_place"), kind.alias("_kind"), F.when(kind == 1, F.col("_v")).alias("_inside"), "_v")
    counts = near.groupBy(*by, "_i", "_place", "_kind", "_inside").agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    w = Window.partitionBy(*by, "_i").orderBy("_kind", "_inside").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))

    def ranked_value(r: Column) -> Column:
        held = (F.col("_kind") == 1) & (F.col("_before") < r) & (r <= F.col("_before") + F.col("_c"))
        last = (F.col("_kind") == 0) & (r == F.col("_c"))
        next_ = (F.col("_kind") == 2) & (r == F.col("_before") + 1)
        return F.max(F.when(held, F.col("_inside")).when(last, F.col("_most")).when(next_, F.col("_least")))

    low = F.floor("_place") + 1
    found = counts.groupBy(*by, "_i", "_place").agg(ranked_value(low).alias("_a"), ranked_value(F.ceil("_place") + 1).alias("_z"))
    part = F.col("_place") - F.floor("_place")
    missed = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    a, z = F.col("_a"), F.col("_z")
    q = F.when(a.isNull() | z.isNull(), missed).when(a == z, a).otherwise((1 - part) * a + part * z)
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", q.alias("q")))), lambda s: s["q"]).alias(out))
