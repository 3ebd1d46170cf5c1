"""As-of prices and trading-day arithmetic on (ticker, date, close) bars.

Bars are held in pages: one row for a ticker and month with its bars in order, their number so far, and the neighbours on
either side; months without bars repeat the page before them. A lookup is an equi-join of the needed days with pages by ticker and month, and a
search in one page of at most 31 bars: no range join, no sort of a ticker's bars, and Spark can split a join where one ticker
has many of the days. Windows run over pages, of which a ticker has twelve a year.
Staleness and edge rules are the callers' own and come after the lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pages(bars: DataFrame) -> DataFrame:
    """(ticker, month, held, count, before, after): bars of a ticker and month as structs (date, close) in order; `count` of them before the page;
    `after`, the first bar of the next page; `before`, the last one of the page before. Every month from the first to the last has a page."""
    month = F.trunc("date", "month")
    own = bars.groupBy("ticker", month.alias("month")).agg(F.array_sort(F.collect_list(F.struct("date", F.col("close").cast("double").alias("close")))).alias("held"))
    w = Window.partitionBy("ticker").orderBy("month")
    own = own.withColumn("count", F.coalesce(F.sum(F.size("held")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    own = own.withColumn("before", F.lag(F.element_at("held", -1)).over(w)).withColumn("after", F.lead(F.element_at("held", 1)).over(w)).withColumn("next", F.lead("month").over(w))
    months = F.sequence("month", F.coalesce(F.add_months("next", -1), F.col("month")), F.expr("interval 1 month"))
    return own.withColumn("month", F.explode(months)).drop("next")


def positioned(bars: DataFrame) -> DataFrame:
    """Bars with `pos`, the trading day's number within the ticker from 1."""
    held = pages(bars)
    out = held.where(F.trunc(F.element_at("held", 1)["date"], "month") == F.col("month"))  # pages of months that have bars
    out = out.select("ticker", "count", F.posexplode("held").alias("at", "bar"))
    out = out.select("ticker", "bar.date", "bar.close", (F.col("count") + F.col("at") + 1).cast("int").alias("pos"))
    out.pages = held
    return out


def series(bars: DataFrame) -> DataFrame:
    """(ticker, n_bars, first_bar, last_bar)."""
    return bars.groupBy("ticker").agg(F.count("*").alias("n_bars"), F.min("date").alias("first_bar"), F.max("date").alias("last_bar"))


def lookup(bars: DataFrame, probes: DataFrame, day: str = "day", side: str = "<=", prefix: str = "") -> DataFrame:
    """probes (ticker, `day`, ...) with date, close and pos of the last bar `<=` or `<` the day,
    or of the first bar `>=` it; null where there is none.

    bars as from positioned(), or any (ticker, date, close), whose pages are then made here."""
    held = getattr(bars, "pages", None)
    held = pages(bars) if held is None else held
    p = held.select(F.col("ticker").alias("_t"), F.col("month").alias("_m"), F.col("held").alias("_held"), F.col("count").alias("_count"), F.col("before").alias("_before"), F.col("after").alias("_after"))
    last = F.max(F.struct("month", F.element_at("held", -1).alias("bar"), (F.col("count") + F.size("held")).alias("pos")))
    ends = held.groupBy(F.col("ticker").alias("_e")).agg(F.min(F.struct("month", F.element_at("held", 1).alias("bar"))).alias("_first"), last.alias("_last"))
    d = F.col(day).cast("date")
    out = probes.join(p, (F.col("ticker") == F.col("_t")) & (F.trunc(d, "month") == F.col("_m")), "left").join(ends, F.col("ticker") == F.col("_e"), "left")
    upto = F.size(F.filter("_held", lambda b: b["date"] <= d if side == "<=" else b["date"] < d))
    in_page, page = F.col("_t").isNotNull(), F.col("_held")
    if side == ">=":
        inner = F.when(upto < F.size(page), F.get(page, upto)).otherwise(F.col("_after"))
        bar = F.when(in_page, inner).when(d < F.col("_first.month"), F.col("_first.bar"))
        pos = F.when(in_page, F.col("_count") + upto + 1).when(d < F.col("_first.month"), 1)
    else:
        inner = F.when(upto > 0, F.get(page, upto - 1)).otherwise(F.col("_before"))
        bar = F.when(in_page, inner).when(d > F.col("_last.month"), F.col("_last.bar"))
        pos = F.when(in_page, F.col("_count") + upto).when(d > F.col("_last.month"), F.col("_last.pos"))
    out = out.withColumn("_bar", bar).withColumn("_pos", F.when(F.col("_bar").isNotNull(), pos).cast("int"))
    return out.select(*(probes[c] for c in probes.columns), F.col("_bar.date").alias(f"{prefix}date"), F.col("_bar.close").alias(f"{prefix}close"), F.col("_pos").alias(f"{prefix}pos"))


def strips(bars: DataFrame, bench: DataFrame, known: bool = False) -> DataFrame:
    """(ticker, dates, closes, benches): all bars of a ticker in order, in one row, which the calendar bounds, with the
    benchmark's last close on or before each date: null before it starts, or with `known` without those dates.

    Bars are shuffled by ticker once. What joins these rows on the ticker alone finds a bar's place by upto() and a place's bar by
    F.get: no row per place is made to be joined. Ask for a merge of the sorted sides in such joins (`hint("merge")`)."""
    own = beside(bars.select("ticker", "date", F.col("close").cast("double").alias("close")).repartition("ticker"), bench)
    own = own.where("bench is not null") if known else own
    rows = own.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "close", "bench"))).alias("_held"))
    return rows.select("ticker", F.col("_held.date").alias("dates"), F.col("_held.close").alias("closes"), F.col("_held.bench").alias("benches"))


def beside(rows: DataFrame, bench: DataFrame) -> DataFrame:
    """rows (date, ...) with `bench`, the benchmark's last close on or before the date: a broadcast of a row for each calendar day from its first to its last."""
    one = bench.groupBy("date").agg(F.max("close").cast("double").alias("close")).where("date is not null")
    ends = F.coalesce(F.date_sub(F.lead("date").over(Window.orderBy("date")), 1), F.col("date"))  # a row per calendar date
    days = one.withColumn("_end", ends).select(F.explode(F.sequence("date", "_end")).alias("date"), F.col("close").alias("bench"))
    last = one.agg(F.max_by("close", "date").alias("_last"), F.max("date").alias("_until"))
    out = rows.join(F.broadcast(days), "date", "left").crossJoin(F.broadcast(last))  # one row
    return out.withColumn("bench", F.when(F.col("date") > F.col("_until"), F.col("_last")).otherwise(F.col("bench"))).drop("_last", "_until")


def upto(dates: Column, day: Column, before: bool = False) -> Column:
    """How many of the dates, in order, are on or before the day, or before it: halved from the largest power of two. Null for no day."""
    halves = F.array(*(F.lit(1 << k) for k in range(22, -1, -1)))  # more days than Spark's calendar has
    found = lambda at: F.get(dates, at - 1) < day if before else F.get(dates, at - 1) <= day
    return F.when(day.isNotNull(), F.aggregate(halves, F.lit(0), lambda at, step: F.when(found(at + step), at + step).otherwise(at)))


def close_at(bars: DataFrame, probes: DataFrame, max_stale_days: int = 14, day: str = "day") -> DataFrame:
    """probes with `px`, the last close on or before the day, null if older than max_stale_days."""
    fresh = F.datediff(day, "_px_date") <= max_stale_days
    out = lookup(positioned(bars), probes, day, prefix="_px_")
    return out.withColumn("px", F.when(fresh, F.col("_px_close"))).drop("_px_date", "_px_close", "_px_pos")


def forward_return(bars: DataFrame, starts: DataFrame, days: int, max_stale_days: int = 14, max_gap_days: int = 45) -> DataFrame:
    """starts (start_id, ticker, start) with `ret` over `days` calendar days; null if the entry is
    stale or not positive, the exit is further than max_gap_days from its day, or both are the same print."""
    probes = starts.select("start_id", "ticker", F.explode(F.array(F.struct(F.lit(0).alias("leg"), F.col("start").alias("day")), F.struct(F.lit(1).alias("leg"), F.date_add("start", days).alias("day")))).alias("x")).select("start_id", "ticker", "x.*")
    hit = lookup(positioned(bars), probes)
    legs = hit.groupBy("start_id").agg(*(F.max(F.when(F.col("leg") == k, F.struct("day", "date", "close"))).alias(n) for k, n in ((0, "a"), (1, "z"))))
    fine = (F.datediff("a.day", "a.date") <= max_stale_days) & (F.datediff("z.day", "z.date") <= max_gap_days) & (F.col("a.date") < F.col("z.date")) & (F.col("a.close") > 0)
    return starts.join(legs.select("start_id", F.when(fine, F.col("z.close") / F.col("a.close") - 1).alias("ret")), "start_id", "left")


def benchmark_return(bench: DataFrame, starts: DataFrame, months: int, max_gap_days: int = 45) -> DataFrame:
    """starts (start_id, start) with `bench_ret`: last closes on or before both ends; the end's may be max_gap_days old."""
    one = positioned(bench.select(F.lit("b").alias("ticker"), "date", "close"))
    days = starts.select("start").distinct().select(F.lit("b").alias("ticker"), "start", F.explode(F.array(F.struct(F.lit(0).alias("leg"), F.col("start").alias("day")), F.struct(F.lit(1).alias("leg"), F.add_months("start", months).alias("day")))).alias("x"))
    hit = lookup(one, days.select("ticker", "start", "x.*"))
    legs = hit.groupBy("start").agg(*(F.max(F.when(F.col("leg") == k, F.struct("day", "date", "close"))).alias(n) for k, n in ((0, "a"), (1, "z"))))
    fine = (F.datediff("z.day", "z.date") <= max_gap_days) & (F.col("a.close") > 0)
    return starts.join(legs.select("start", F.when(fine, F.col("z.close") / F.col("a.close") - 1).alias("bench_ret")), "start", "left")


def calendar(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """(date, bench): the benchmark's last close on or before each date that any ticker trades.
    A row for each date of the calendar at most: small enough to broadcast for any number of tickers."""
    days = bars.select("date").distinct().select(F.lit("b").alias("ticker"), F.col("date").alias("day"))
    hit = lookup(positioned(bench.select(F.lit("b").alias("ticker"), "date", "close")), days)
    return hit.where("close is not null").select(F.col("day").alias("date"), F.col("close").alias("bench"))


def shift_trading_days(bars: DataFrame, probes: DataFrame, day: str = "day", k: str = "k") -> DataFrame:
    """probes (ticker, day, k) with `shifted`: the day itself for k = 0; k bars on from the first
    bar at or after it, or back from the last bar at or before it; null off either end."""
    pos = positioned(bars)
    out = lookup(pos, lookup(pos, probes, day, ">=", "_f_"), day, "<=", "_b_")
    at = F.when(F.col(k) > 0, F.col("_f_pos") + F.col(k)).when(F.col(k) < 0, F.col("_b_pos") + F.col(k))
    out = out.withColumn("_at", at)
    grid = pos.select(F.col("ticker").alias("_t"), F.col("pos").alias("_p"), F.col("date").alias("_date"))
    out = out.join(grid, (F.col("ticker") == F.col("_t")) & (F.col("_at") == F.col("_p")), "left")
    return out.select(*probes.columns, F.when(F.col(k) == 0, F.col(day)).otherwise(F.col("_date")).alias("shifted"))


def priced_flags(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with `priced`: the ticker has any bar."""
    held = bars.select("ticker").distinct().withColumn("priced", F.lit(True))
    return rows.join(held, "ticker", "left").withColumn("priced", F.coalesce("priced", F.lit(False)))


def fresh_close_flags(bars: DataFrame, rows: DataFrame, day: str = "as_of_date", min_bars: int = 30, max_stale_days: int = 14) -> DataFrame:
    """rows with `usable`: a close at most max_stale_days old, in a series of min_bars or more."""
    out = close_at(bars, rows, max_stale_days, day).join(series(bars).select("ticker", "n_bars"), "ticker", "left")
    return out.withColumn("usable", F.col("px").isNotNull() & (F.coalesce("n_bars", F.lit(0)) >= min_bars)).drop("px", "n_bars")


def split_scan(bars: DataFrame, start: Column, low: float = 0.8, high: float = 1.25) -> DataFrame:
    """Bars from `start` on whose close is outside [low, high] times the one before it (previous close positive)."""
    w = Window.partitionBy("ticker").orderBy("date")
    out = bars.where(F.col("date") >= start).withColumn("prev", F.lag("close").over(w)).where("prev > 0")
    out = out.withColumn("ratio", F.col("close") / F.col("prev"))
    return out.where((F.col("ratio") < low) | (F.col("ratio") > high)).select("ticker", "date", "prev", "close", "ratio")
