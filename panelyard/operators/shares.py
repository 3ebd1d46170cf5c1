"""Share counts across splits: flags, corroboration, bases, market value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Split factors tried in order, and declared ratios, of which the nearest is taken.
FLAG_FACTORS = (2, 3, 4, 5, 6, 7, 8, 10, 20)
DECLARED = (2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 25, 30, 40, 50, 100, 1.5)


def split_basis_flags(counts: DataFrame, tol: float = 0.06) -> DataFrame:
    """(cik, fiscal_year, shares) -> (cik, flag_year, ratio, factor): steps between adjacent years near n or 1/n."""
    w = Window.partitionBy("cik").orderBy("fiscal_year")
    pairs = counts.where("shares <> 0").withColumn("_py", F.lag("fiscal_year").over(w)).withColumn("_ps", F.lag("shares").over(w)).where("fiscal_year - _py = 1")
    ratio = F.col("shares") / F.col("_ps")
    tries = [t for n in FLAG_FACTORS for t in (F.when(F.abs(ratio - n) <= n * tol, float(n)), F.when(F.abs(ratio - 1 / n) <= tol / n, 1 / n))]
    return pairs.select("cik", F.col("fiscal_year").alias("flag_year"), ratio.alias("ratio"), F.coalesce(*tries).alias("factor")).where("factor is not null")


def corroborate_flags(flags: DataFrame, outstanding: DataFrame, lookahead: int = 3, lo: float = 0.7, hi: float = 1.4) -> DataFrame:
    """flags with baseline_year, step, step_year and verdict from never-restated counts
    (cik, fiscal_year, shares): the first of the next years inside [lo, hi] x factor of the
    baseline corroborates; else the closest one in log space is shown and contradicts."""
    so = outstanding.where("shares > 0 and not isnan(shares)").select("cik", F.col("fiscal_year").alias("y"), F.col("shares").cast("double").alias("so"))
    near = flags.join(so, "cik", "left")
    base = near.groupBy("cik", "flag_year", "ratio", "factor").agg(F.max(F.when(F.col("y") <= F.col("flag_year"), F.struct("y", "so"))).alias("base"))
    after = base.join(so, "cik", "left").withColumn("r", F.when(F.col("y").between(F.col("flag_year") + 1, F.col("flag_year") + lookahead), F.col("so") / F.col("base.so")))
    inside = F.col("r").between(lo * F.col("factor"), hi * F.col("factor"))
    out = after.groupBy("cik", "flag_year", "ratio", "factor", "base").agg(F.min(F.when(inside, F.struct("y", "r"))).alias("hit"), F.min(F.when(F.col("r").isNotNull(), F.struct(F.abs(F.ln(F.col("r") / F.col("factor"))).alias("gap"), "y", "r"))).alias("best"))
    verdict = F.when(F.col("hit").isNotNull(), "corroborated").when(F.col("best").isNotNull(), "contradicted").otherwise("untestable")
    return out.select("cik", "flag_year", "ratio", "factor", F.col("base.y").alias("baseline_year"), F.coalesce("hit.r", "best.r").alias("step"), F.coalesce("hit.y", "best.y").alias("step_year"), verdict.alias("verdict"))


def rebase(counts: DataFrame, splits: DataFrame) -> DataFrame:
    """(cik, fiscal_year, shares) with `rebased`: times the factors of all later splits (cik, split_year, factor)."""
    later = counts.join(splits.select("cik", "split_year", "factor"), "cik", "left").where("split_year > fiscal_year")
    times = later.groupBy("cik", "fiscal_year").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("split_year", "factor"))), F.lit(1.0), lambda a, s: a * s["factor"]).alias("_times"))
    return counts.join(times, ["cik", "fiscal_year"], "left").withColumn("rebased", F.col("shares") * F.coalesce("_times", F.lit(1.0))).drop("_times")


def series_sanity(both: DataFrame, lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """(cik, fiscal_year, outstanding, diluted) rows whose ratio is outside [lo, hi]; both must be positive."""
    return both.where("outstanding > 0 and diluted > 0").withColumn("ratio", F.col("outstanding") / F.col("diluted")).where(~F.col("ratio").between(lo, hi))


def snap(factor: Column, tol: float = 0.10) -> Column:
    """struct(factor, snapped): the nearest declared ratio in log space if within tol, else the factor itself."""
    candidates = F.array(*(F.lit(float(c)) for c in DECLARED), *(F.lit(1.0 / c) for c in DECLARED))
    best = F.array_min(F.transform(candidates, lambda c, i: F.struct(F.abs(F.ln(factor / c)).alias("gap"), i.alias("i"), c.alias("c"))))
    return F.struct(F.when(best["gap"] < tol, best["c"]).otherwise(factor).alias("factor"), (best["gap"] < tol).alias("snapped"))


def firm_basis(both: DataFrame, lo: float = 0.5, hi: float = 2.0, max_run: int = 2, fmin: float = 1 / 60, fmax: float = 60.0) -> DataFrame:
    """(cik, fiscal_year, outstanding, diluted, implied) -> one row per run of years whose counts
    are on different bases: first_year, last_year, run_len, split_year, factor, snapped, resolved.

    The diluted count is read first, the implied one where it is absent. A run is a split in the
    year after it if it is short, its factor plausible, and the outstanding count's own step is
    nearer to the factor than to 1; else it is unresolved."""
    d = F.coalesce(F.when(F.col("diluted") != 0, F.col("diluted")), F.col("implied"))
    rows = both.where(F.col("outstanding") > 0).withColumn("ratio", F.when(d > 0, F.col("outstanding") / d))
    flagged = rows.where(~F.col("ratio").between(lo, hi)).withColumn("_g", F.col("fiscal_year") - F.row_number().over(Window.partitionBy("cik").orderBy("fiscal_year")))
    runs = flagged.groupBy("cik", "_g").agg(F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"), F.count("*").alias("run_len"), (1 / F.median("ratio")).alias("factor_wasd")).drop("_g")
    so = both.select("cik", "fiscal_year", "outstanding")
    runs = runs.withColumn("split_year", F.col("last_year") + 1)
    runs = runs.join(so.select("cik", F.col("fiscal_year").alias("split_year"), F.col("outstanding").alias("_s")), ["cik", "split_year"], "left").join(so.select("cik", F.col("fiscal_year").alias("last_year"), F.col("outstanding").alias("_p")), ["cik", "last_year"], "left")
    runs = runs.withColumn("so_step", F.when(F.col("_p") != 0, F.col("_s") / F.col("_p")))
    fine = F.coalesce((F.col("run_len") <= max_run) & F.col("factor_wasd").between(fmin, fmax) & (F.abs(F.ln(F.col("so_step") / F.col("factor_wasd"))) < F.abs(F.ln("so_step"))), F.lit(False))
    snapped = snap(F.sqrt(F.col("factor_wasd") * F.col("so_step")))
    return runs.select("cik", "first_year", "last_year", "run_len", "split_year", F.when(fine, snapped["factor"]).alias("factor"), F.when(fine, snapped["snapped"]).alias("snapped"), fine.alias("resolved"))


def market_cap(shares: Column, close: Column, period_end: Column, as_of: Column) -> Column:
    """Shares times close, null unless the period ended before the date and both are positive."""
    return F.when((period_end < as_of) & (shares > 0) & (close > 0), shares * close)


def decompose(p0: Column, p1: Column, rev0: Column, rev1: Column, sh0: Column, sh1: Column) -> Column:
    """struct(ret, rps, mult): price ratio, revenue-per-share ratio, and multiple ratio; ret = rps x mult."""
    ret, rps = F.try_divide(p1, p0), F.try_divide(F.try_divide(rev1, sh1), F.try_divide(rev0, sh0))
    return F.struct(ret.alias("ret"), rps.alias("rps"), F.try_divide(ret, rps).alias("mult"))
