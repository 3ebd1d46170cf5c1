"""Label shuffles that keep what a null must keep, and the multiplicity of a family of cells.

A shuffle is a keyed permutation of positions (functions/draws.py): where a row's or a group's label comes from in each draw is
computed, not sorted. Rows get their positions once, whatever the number of draws, and fetch labels by one equi-join on position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import WORD, key, mix, permuted
from ..sources.tables import durable, numbered, settled
from .ranks import null_safe
from .resample import indexed


def _dealt(rows: DataFrame, seed: int, draws: int, out: str) -> DataFrame:
    """rows (..., _x, _n, _c) once per draw, with `out`: where the draw's permutation of 0.._n-1, keyed by the cell _c too, takes _x."""
    schema = rows.drop("_x", "_n", "_c").withColumn("draw", F.lit(0).cast("long")).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches):
        keys = key(seed, np.arange(1, draws + 1))
        for b in batches:
            held = b.drop_columns(["_x", "_n", "_c"])
            x, n, c = (b.column(k).to_numpy() for k in ("_x", "_n", "_c"))
            for at in range(0, draws, max(1, (1 << 18) // max(1, b.num_rows))):
                now = keys[at : at + max(1, (1 << 18) // max(1, b.num_rows))]
                rows, draw = np.tile(np.arange(b.num_rows), len(now)), np.repeat(np.arange(len(now)), b.num_rows)
                to = permuted(x[rows], n[rows], mix(now[draw] ^ (c[rows].astype(np.uint64) & np.uint64(WORD))))
                yield pa.RecordBatch.from_arrays([*held.take(pa.array(rows)).columns, pa.array(draw + at + 1, pa.int64()), pa.array(to.astype(np.int64))], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def _bijection(df: DataFrame, group: str, seed: int, draws: int) -> DataFrame:
    """(draw, grp, partner): per draw each group's partner, a permutation of all groups."""
    own = indexed(df, group)
    dealt = _dealt(own.select("grp", F.col("idx").alias("_x"), F.col("n").alias("_n"), F.lit(0).cast("long").alias("_c")), seed, draws, "_to")
    return dealt.join(own.select(F.col("grp").alias("partner"), F.col("idx").alias("_to")), "_to").select("draw", "grp", "partner")


def clustered_shuffle(df: DataFrame, label: str, group: str, row_id: str, within: str | None = None, seed: int = 0, draws: int = 1, out: str = "shuffled") -> DataFrame:
    """df per draw with `shuffled`: each group takes one partner group's labels, as a whole path.

    Without `within`, the i-th row of all that read a partner takes the partner's i-th label,
    going round. With it, a row reads the partner's cell of the same key, or else of the nearest
    key by position in the sorted list of all keys, the earlier one on a tie; the i-th of all
    rows that read a cell takes its i-th label, going round. No row is dropped; `fell_back` marks
    rows that read another key. Rows are in the order of row_id, a unique key."""
    df = durable(df, "shuffled")
    cell = ["_g"] if within is None else ["_g", "_k"]
    base = df.withColumn("_g", F.col(group))
    if within is not None:
        keys = df.select(within).distinct().withColumn("_k", F.row_number().over(Window.orderBy(within)))
        base = base.join(keys, within)
    source = base.select(*cell, F.col(label).alias(out), (F.row_number().over(Window.partitionBy(*cell).orderBy(row_id)) - 1).alias("_i"))
    sizes = base.groupBy(*cell).agg(F.count("*").alias("_n"))
    pairs = _bijection(df, group, seed, draws)
    rows = base.join(pairs, F.col("_g") == F.col("grp")).withColumn("_p", F.col("partner"))
    if within is None:
        rows = rows.join(sizes.withColumnRenamed("_g", "_p"), "_p").withColumn("fell_back", F.lit(False))
        at = ["draw", "_p"]
    else:
        held = sizes.groupBy("_g").agg(F.array_sort(F.collect_list("_k")).alias("_keys")).withColumnRenamed("_g", "_p")
        near = F.array_min(F.transform("_keys", lambda k: F.struct(F.abs(k - F.col("_k")).alias("gap"), k.alias("k"))))["k"]
        rows = rows.join(held, "_p").withColumn("_s", near).withColumn("fell_back", F.col("_s") != F.col("_k"))
        rows = rows.join(sizes.withColumnRenamed("_g", "_p").withColumnRenamed("_k", "_s"), ["_p", "_s"])
        at = ["draw", "_p", "_s"]
    rows = rows.withColumn("_i", F.pmod(F.row_number().over(Window.partitionBy(*at).orderBy(row_id)) - 1, F.col("_n")).cast("int"))
    source = source.withColumnRenamed("_g", "_p")
    if within is not None:
        source = source.withColumnRenamed("_k", "_s")
    return rows.join(source, [*at[1:], "_i"]).select(*df.columns, "draw", out, "fell_back")


def within_shuffle(df: DataFrame, label: str, by: list[str], row_id: str, seed: int = 0, draws: int = 1, out: str = "shuffled") -> DataFrame:
    """df per draw with the labels of each cell of `by` permuted inside it (by firm; by firm and stratum; by stratum).

    Positions follow `by`, then row_id, a unique key. A cell's rows are never together in one task."""
    rows = numbered(df, [*by, row_id], "_pos")
    cells = rows.groupBy(*by).agg(F.min("_pos").alias("_c"), F.count("*").alias("_n"))
    rows_ = null_safe(rows, cells, by).withColumn("_x", F.col("_pos") - F.col("_c")).withColumn("_first", F.col("_c")).drop("_pos")
    dealt = _dealt(rows_, seed, draws, "_to").withColumn("_pos", F.col("_first") + F.col("_to"))
    return dealt.join(rows.select("_pos", F.col(label).alias(out)), "_pos").select(*df.columns, "draw", out)


def unit_shuffle(df: DataFrame, label: str, unit: str, stratum: str, seed: int = 0, draws: int = 1, out: str = "shuffled") -> DataFrame:
    """Labels of units permuted inside their stratum; the rows of a unit move as one."""
    units = df.groupBy(stratum, unit).agg(F.min(label).alias(label))
    return df.join(within_shuffle(units, label, [stratum], unit, seed, draws, out).select(stratum, unit, "draw", out), [stratum, unit])


def cell_mean_shuffle(df: DataFrame, label: str, group: str, within: str, seed: int = 0, draws: int = 1, out: str = "shuffled") -> DataFrame:
    """Each row takes the mean label of the partner group's cell of the same key, else of the whole partner."""
    df = durable(df, "shuffled")
    pairs = _bijection(df, group, seed, draws)
    cells = df.groupBy(F.col(group).alias("partner"), F.col(within).alias("_k")).agg(F.avg(label).alias("_cell"))
    whole = df.groupBy(F.col(group).alias("partner")).agg(F.avg(label).alias("_all"))
    rows = df.join(pairs, F.col(group) == F.col("grp")).join(whole, "partner").join(cells, (cells.partner == pairs.partner) & (F.col(within) == F.col("_k")), "left")
    return rows.select(*(df[c] for c in df.columns), "draw", F.coalesce("_cell", "_all").alias(out))


def placebo_table(observed: DataFrame, draws: DataFrame, by: list[str]) -> DataFrame:
    """observed (by..., value) against draws (by..., draw, value): null mean, sd, z, p95 of |null|,
    ratio of the null's mean to the observed, share of draws at least as extreme."""
    rows = draws.withColumnRenamed("value", "null_value").join(observed, by)
    out = rows.groupBy(*by).agg(
        F.max("value").alias("observed"), F.avg("null_value").alias("null_mean"), F.stddev_samp("null_value").alias("null_sd"), F.percentile(F.abs("null_value"), 0.95).alias("p95_abs"),
        F.avg((F.abs("null_value") >= F.abs("value")).cast("double")).alias("share_as_extreme"),
    )
    return out.withColumn("z", F.try_divide(F.col("observed") - F.col("null_mean"), F.col("null_sd"))).withColumn("ratio", F.try_divide(F.col("null_mean"), F.col("observed")))


def family_chance(observed: DataFrame, nulls: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: how many cells clear their nulls, and how many do by chance.

    observed (cell, value); nulls (cell, null_name, draw, value), draws from 1. A value clears
    when for each null at most alpha of its draws are as far out in the value's own direction. A
    chance family is the draws of the first null (by name) of each cell; shares are by rank, not
    by comparing all pairs of draws. Draws are written once: they stand on both sides of the comparison, and sums that are
    worked out twice differ in their last digits, so that a draw may not count as equal to itself."""
    nulls = durable(nulls.select("cell", "null_name", "draw", "value"), "nulls")
    first = nulls.groupBy("cell").agg(F.min("null_name").alias("_first"))
    n_draws = nulls.groupBy("cell", "null_name").count().agg(F.min("count").alias("draws"))
    trial = nulls.join(first, "cell").where("null_name = _first").select("cell", "draw", "value").unionByName(observed.select("cell", F.lit(0).cast(nulls.schema["draw"].dataType).alias("draw"), "value"))
    # every tested value goes among the draws of each of its cell's nulls; counts at or beyond it by running sums
    names = nulls.select("cell", "null_name").distinct()
    points = trial.join(names, "cell").select("cell", "null_name", "value", "draw", F.lit(0).alias("is_null"))
    mixed = points.unionByName(nulls.select("cell", "null_name", "value", F.lit(None).cast(nulls.schema["draw"].dataType).alias("draw"), F.lit(1).alias("is_null")))
    w = Window.partitionBy("cell", "null_name").orderBy("value").rangeBetween(Window.unboundedPreceding, 0)
    total = F.sum("is_null").over(Window.partitionBy("cell", "null_name"))
    below = mixed.withColumn("_le", F.sum("is_null").over(w)).withColumn("_n", total).withColumn("_lt", F.col("_n") - F.sum("is_null").over(Window.partitionBy("cell", "null_name").orderBy(F.col("value").desc()).rangeBetween(Window.unboundedPreceding, 0))).where("is_null = 0")
    share = F.when(F.col("value") >= 0, F.col("_n") - F.col("_lt")).otherwise(F.col("_le")) / F.col("_n")
    clear = below.groupBy("cell", "draw").agg(F.bool_and(share <= alpha).alias("clear"))
    counts = clear.groupBy("draw").agg(F.sum(F.col("clear").cast("int")).alias("k"), F.count("*").alias("cells"))
    seen = counts.where("draw = 0").select(F.col("cells").alias("n_cells"), F.col("k").alias("observed_clear"))
    out = counts.where("draw > 0").crossJoin(F.broadcast(n_draws)).where("draw <= draws").crossJoin(F.broadcast(seen))  # one row each
    out = out.groupBy("n_cells", "observed_clear", "draws").agg(
        F.avg("k").alias("expected"), F.stddev_pop("k").alias("sd"), F.percentile("k", 0.95).alias("p95"), F.avg((F.col("k") >= 1).cast("double")).alias("p_any"), F.avg((F.col("k") >= F.col("observed_clear")).cast("double")).alias("p_at_least_observed"),
    )
    return settled(out, nulls)
