"""Failure times and Kaplan-Meier incidence from long paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def failure_times(paths: DataFrame, by: list[str], value: str = "r", threshold: float = -0.5) -> DataFrame:
    """Per path: the first k with value <= threshold (null if none) and the last observed k (0 if none)."""
    return paths.groupBy(*by).agg(F.min(F.when(F.col(value) <= threshold, F.col("k"))).alias("fail"), F.coalesce(F.max(F.when(F.col(value).isNotNull(), F.col("k"))), F.lit(0)).alias("last"))


def kaplan_meier(times: DataFrame, horizon: int, by: list[str] | None = None) -> DataFrame:
    """(by..., k, at_risk, failures, incidence) for k = 1..horizon. Months without events are
    there; where nobody is at risk the curve stays level. A histogram of stops first, so what is
    ordered is horizon rows a group."""
    by = by or []
    stop = F.coalesce("fail", "last")
    counts = times.groupBy(*by, stop.alias("k")).agg(F.count("*").alias("stops"), F.count("fail").alias("failures"))
    grid = times.select(*by).distinct() if by else times.sparkSession.range(1).select()
    grid = grid.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(horizon))))
    rows = grid.join(counts, [*by, "k"], "left").na.fill(0, ["stops", "failures"])
    down = Window.partitionBy(*by).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    over = times.groupBy(*by).agg(F.count(F.when(stop > horizon, 1)).alias("over"))
    rows = rows.join(over, by) if by else rows.crossJoin(F.broadcast(over))  # one row
    rows = rows.withColumn("at_risk", F.sum("stops").over(down) + F.col("over")).where("k > 0")
    step = F.when(F.col("at_risk") == 0, 1.0).otherwise(1 - F.col("failures") / F.col("at_risk"))
    survival = F.aggregate(F.collect_list(step).over(up), F.lit(1.0), lambda a, x: a * x)
    return rows.select(*by, F.col("k").cast("int").alias("k"), "at_risk", "failures", (1 - survival).alias("incidence"))


def survival_curve(paths: DataFrame, path_key: list[str], horizon: int, event: str = "halved", value: str = "r", by: list[str] | None = None) -> DataFrame:
    """Kaplan-Meier incidence of a path's first fall by half. Ends of listing are censoring, not events."""
    if event != "halved":
        raise ValueError(f"event must be 'halved', not {event!r}: a path that ends is censored, its ending is no failure")
    if value not in paths.columns:
        raise ValueError(f"paths have no column {value!r}")
    return kaplan_meier(failure_times(paths, [*path_key, *(by or [])], value), horizon, by)


def crossing(curve: DataFrame, level: float, by: list[str] | None = None) -> DataFrame:
    """The first month with incidence >= level, null if none."""
    return curve.groupBy(*(by or [])).agg(F.min(F.when(F.col("incidence") >= level, F.col("k"))).alias("month"))


def binomial_interval(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The plain binomial interval p -+ z sqrt(p (1 - p) / n)."""
    half = z * F.sqrt(p * (1 - p) / n)
    return p - half, p + half
