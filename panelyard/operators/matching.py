"""Matched controls and trajectories around an anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from .ranks import ranked


def matched_controls(cases: DataFrame, controls: DataFrame, cell: list[str], per_case: int = 3, seed: int = 0) -> DataFrame:
    """cases (case_id, cell...) and controls (control_id, cell...) -> (case_id, control_id).

    Up to per_case distinct controls of the case's cell; different cases may share one. Controls
    are numbered in their cell; a case draws positions from ranges that shrink by one, each draw
    moved past the ones before it, and an equi-join on cell and position fetches them: no
    case meets its whole cell."""
    pool = ranked(controls.select(*cell, "control_id"), cell, ["control_id"]).select(*cell, "control_id", (F.col("_rank") - 1).alias("pos"))
    sizes = pool.groupBy(*cell).agg(F.count("*").alias("n"))
    own = cases.join(sizes, cell)
    taken = F.array().cast("array<bigint>")
    for k in range(per_case):
        # among the n - k positions not taken: past every taken one that is not above it
        r = F.pmod(draw(F.lit(seed), F.lit(k), "case_id"), F.greatest(F.col("n") - k, F.lit(1)))
        moved = F.aggregate(F.array_sort("_taken"), r, lambda a, t: F.when(a >= t, a + 1).otherwise(a))
        own = own.withColumn("_taken", taken if k == 0 else F.col("_taken")).withColumn("_taken", F.when(F.col("n") > k, F.concat("_taken", F.array(moved))).otherwise(F.col("_taken")))
    return own.select("case_id", *cell, F.explode("_taken").alias("pos")).join(pool, [*cell, "pos"]).select("case_id", "control_id")


def unmatched(cases: DataFrame, controls: DataFrame, cell: list[str]) -> DataFrame:
    """Cases whose cell holds no control."""
    return cases.join(controls.select(*cell).distinct(), cell, "left_anti")


def trajectories(anchors: DataFrame, panel: DataFrame, metrics: list[str], first: int = -8, last: int = -1) -> DataFrame:
    """anchors (aid, cik, qi) -> (aid, k, metric, value, change): the metric k quarters from the
    anchor and its change from the window's first quarter; missing quarters are null."""
    grid = anchors.select("aid", "cik", "qi", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("k")).withColumn("_q", F.col("qi") + F.col("k"))
    rows = grid.join(panel.select("cik", F.col("qi").alias("_q"), *metrics), ["cik", "_q"], "left")
    long = rows.select("aid", "k", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("m")).select("aid", "k", "m.*")
    start = F.first("value").over(Window.partitionBy("aid", "metric").orderBy("k"))
    return long.withColumn("change", F.col("value") - start)


def nearest_controls(treated: DataFrame, pool: DataFrame, cell: list[str], value: str) -> DataFrame:
    """(treated_id, control_id): the pool row of the same cell with the nearest value, the lower one on a tie.
    Both are sorted together within the cell; the nearest is a neighbour on one side."""
    both = treated.select(*cell, value, F.col("treated_id").alias("_id"), F.lit(1).alias("_t"), F.lit(None).cast("struct<v:double,id:string>").alias("_c")).unionByName(
        pool.select(*cell, value, F.col("control_id").alias("_id"), F.lit(0).alias("_t"), F.struct(F.col(value).cast("double").alias("v"), F.col("control_id").cast("string").alias("id")).alias("_c"))
    )
    up, down = Window.partitionBy(*cell).orderBy(value, "_t", "_id"), Window.partitionBy(*cell).orderBy(F.col(value).desc(), "_t", "_id")
    near = both.withColumn("_lo", F.last("_c", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_hi", F.last("_c", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))).where("_t = 1")
    lower = F.coalesce(F.col(value) - F.col("_lo.v"), F.lit(float("inf"))) <= F.coalesce(F.col("_hi.v") - F.col(value), F.lit(float("inf")))
    return near.select(F.col("_id").alias("treated_id"), F.when(lower, F.col("_lo.id")).otherwise(F.col("_hi.id")).alias("control_id"))
