"""Forward paths and event-time returns, in long form."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import calendar, lookup, positioned, series, strips, upto
from .ranks import quantiles

MIN_BARS = 30


def forward_paths(entries: DataFrame, bars: DataFrame, horizons: int = 24, max_stale_days: int = 14, edge_days: int = 45) -> DataFrame:
    """entries (entry_id, ticker, as_of_date, year, listed_until) -> (entry_id, ticker, year, k,
    r, x, delisted_in_window) for k = 1..horizons; entries without a usable entry price have no rows.

    r is the return to the last close on or before as_of + k months; null past the series' last
    bar plus edge_days, or past listed_until. x is r minus the median of its entry year and k.
    One lookup serves all horizons: a single sort by ticker."""
    probes = entries.select("entry_id", "ticker", "year", "listed_until", "as_of_date", F.explode(F.sequence(F.lit(0), F.lit(horizons))).alias("k")).withColumn("day", F.expr("add_months(as_of_date, k)"))
    hit = lookup(positioned(bars), probes).join(series(bars), "ticker")
    entry = F.first(F.when((F.col("k") == 0) & (F.datediff("day", "date") <= max_stale_days) & (F.col("close") > 0) & (F.col("n_bars") >= MIN_BARS), F.col("close")), ignorenulls=True)
    hit = hit.withColumn("p0", entry.over(Window.partitionBy("ticker", "entry_id"))).where("p0 is not null")
    past = (F.col("day") > F.date_add("last_bar", edge_days)) | F.coalesce(F.col("day") > F.col("listed_until"), F.lit(False))
    last = F.expr(f"add_months(as_of_date, {horizons})")
    gone = (last > F.col("last_bar")) | F.coalesce(last > F.col("listed_until"), F.lit(False))
    hit = hit.where("k > 0").select("entry_id", "ticker", "year", "k", F.when(~past, F.col("close") / F.col("p0") - 1).alias("r"), gone.alias("delisted_in_window"))
    mid = quantiles(hit, "r", ["year", "k"], [0.5]).select("year", "k", F.col("q")[0].alias("mid"))
    return hit.join(mid, ["year", "k"], "left").where("year is not null").select("entry_id", "ticker", "year", "k", "r", (F.col("r") - F.col("mid")).alias("x"), "delisted_in_window")


def _anchored(events: DataFrame, pos: DataFrame) -> DataFrame:
    """events (event_id, ticker, day) with the last bar before the day (b_*) and the first at or after it (f_*)."""
    return lookup(pos, lookup(pos, events, side="<", prefix="b_"), side=">=", prefix="f_")


def _at(events: DataFrame, pos: DataFrame, offsets: list[int]) -> DataFrame:
    """A row per event and signed offset with the bar there (date, close; null off the ends).
    Offset 0 is the first bar at or after the day, -1 the last one before it."""
    out = events.withColumn("offset", F.explode(F.array(*map(F.lit, offsets))))
    out = out.withColumn("_pos", F.when(F.col("offset") >= 0, F.col("f_pos") + F.col("offset")).otherwise(F.col("b_pos") + 1 + F.col("offset")))
    return out.join(pos.withColumnRenamed("pos", "_pos"), ["ticker", "_pos"], "left").drop("_pos")


def event_window(events: DataFrame, bars: DataFrame, offsets: tuple[int, ...] = (1, 5, 20), max_gap_days: int = 7) -> DataFrame:
    """(event_id, offset, ret): return from the last close before the day (at most max_gap_days
    old) to the offset-th bar after the first at or after it; nothing unless all offsets exist."""
    pos = positioned(bars)
    own = _anchored(events, pos).where(F.datediff("day", "b_date") <= max_gap_days).join(series(bars).select("ticker", "n_bars"), "ticker").where(F.col("n_bars") >= F.col("f_pos") + max(offsets))
    return _at(own, pos, list(offsets)).select("event_id", "offset", (F.col("close") / F.col("b_close") - 1).alias("ret"))


def abnormal_window(events: DataFrame, bars: DataFrame, bench: DataFrame, offsets: tuple[int, ...] = (1, 5, 20), max_gap_days: int = 7) -> DataFrame:
    """event_window minus the same on the benchmark, on the benchmark's own trading days."""
    own = event_window(events, bars, offsets, max_gap_days)
    days = events.select("day").distinct().select(F.col("day").cast("string").alias("event_id"), F.lit("b").alias("ticker"), "day")
    base = event_window(days, bench.select(F.lit("b").alias("ticker"), "date", "close"), offsets, max_gap_days).select(F.col("event_id").alias("_day"), "offset", F.col("ret").alias("bench_ret"))
    out = own.join(events.select("event_id", F.col("day").cast("string").alias("_day")), "event_id").join(F.broadcast(base), ["_day", "offset"])
    return out.select("event_id", "offset", (F.col("ret") - F.col("bench_ret")).alias("ar"))


def with_benchmark(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Bars with the benchmark's close on their date; dates before the benchmark starts are dropped, then positions are counted."""
    cal = F.broadcast(calendar(bars, bench))
    out = positioned(bars.join(cal, "date", "left_semi"))
    both = out.join(cal, "date").select("ticker", "date", "close", "bench", "pos")
    both.pages = out.pages
    return both


def abnormal_path(events: DataFrame, bars: DataFrame, bench: DataFrame, lo: int, hi: int, max_gap_days: int = 7) -> DataFrame:
    """(event_id, offset, ar) for lo..hi: return from the last close before the day, minus the
    benchmark's on the same dates; offset -1 is zero, missing offsets are null."""
    pos = with_benchmark(bars, bench)
    own = _anchored(events, pos).where(F.datediff("day", "b_date") <= max_gap_days)
    base = pos.select("ticker", F.col("pos").alias("b_pos"), F.col("bench").alias("b_bench"))
    out = _at(own.join(base, ["ticker", "b_pos"]), pos, list(range(lo, hi + 1)))
    return out.select("event_id", "offset", (F.col("close") / F.col("b_close") - F.col("bench") / F.col("b_bench")).alias("ar"))


def daily_windows(events: DataFrame, bars: DataFrame, bench: DataFrame, lo: int, hi: int) -> DataFrame:
    """events (event_id, ticker, day) -> (event_id, ticker, f_pos, ars): the place of the first bar at or after the day, among those on
    which the benchmark has a close, and the bar-to-bar returns minus the benchmark's for lo..hi around it, null unless
    all are there. Events without such a bar have no row."""
    held = strips(bars, bench, known=True)
    before = lambda c: F.concat(F.array(F.lit(None).cast("double")), F.slice(c, 1, F.size(c) - 1))
    change = lambda c: F.zip_with(c, before(c), lambda x, y: x / y - 1)
    ars = F.zip_with(change("closes"), change("benches"), lambda a, b: a - b)
    held = held.select("ticker", "dates", ars.alias("_all"))
    out = events.select("event_id", "ticker", F.col("day").cast("date").alias("day")).join(held.hint("merge"), "ticker")
    out = out.withColumn("f_pos", upto(F.col("dates"), F.col("day"), before=True) + 1).where(F.col("f_pos") <= F.size("dates"))
    window = F.slice("_all", F.greatest(F.col("f_pos") + lo, F.lit(1)), hi - lo + 1)
    fits = (F.col("f_pos") + lo >= 1) & (F.col("f_pos") + hi <= F.size("dates"))
    out = out.withColumn("_ars", F.when(fits, window)).drop("dates", "_all", "day")
    return out.select("event_id", "ticker", "f_pos", F.when(F.forall("_ars", lambda x: x.isNotNull()), F.col("_ars")).alias("ars"))


def daily_abnormal(events: DataFrame, bars: DataFrame, bench: DataFrame, lo: int, hi: int) -> DataFrame:
    """(event_id, offset, ar): bar-to-bar return minus the benchmark's, for lo..hi around the
    first bar at or after the day; only events with every offset."""
    out = daily_windows(events, bars, bench, lo, hi).where("ars is not null").select("event_id", F.posexplode("ars").alias("offset", "ar"))
    return out.select("event_id", (F.col("offset") + lo).alias("offset"), "ar")


def med_abs_ratio(ar: DataFrame, day: int = 0, quiet_min: int = 6) -> DataFrame:
    """One row: median |ar| at the offset over the median |ar| of all cells at least quiet_min away."""
    at = F.when(F.col("offset") == day, "day").when(F.abs("offset") >= quiet_min, "quiet")
    mid = quantiles(ar.withColumn("_at", at).where("_at is not null"), F.abs("ar"), ["_at"], [0.5])
    of = lambda name: F.max(F.when(F.col("_at") == name, F.col("q")[0]))
    return mid.agg((of("day") / of("quiet")).alias("ratio"))


def paths_between(pairs: DataFrame, bars: DataFrame, bench: DataFrame, points: int = 10, post_days: int = 20, min_trading_days: int = 20, max_gap_days: int = 7, min_bars: int = 60) -> DataFrame:
    """path_between with one row a pair: (pair_id, ntd, p, q, pre20, pre, post), p and q being arrays of the legs' values from k = 1."""
    held = strips(bars, bench).select("ticker", "dates", F.zip_with("closes", "benches", lambda c, b: F.ln(c) - F.ln(b)).alias("_v"))
    two = pairs.select("pair_id", "ticker", *(F.col(c).cast("date").alias(c) for c in ("d0", "d1"))).join(held.hint("merge"), "ticker").where(F.size("dates") >= min_bars)
    dates = F.col("dates")
    two = two.withColumn("a_pos", upto(dates, F.col("d0"))).withColumn("z_pos", upto(dates, F.col("d1"), before=True)).withColumn("ntd", F.col("z_pos") - F.col("a_pos"))
    gap = lambda day, pos: F.datediff(day, F.get(dates, F.col(pos) - 1))
    two = two.where((gap("d0", "a_pos") <= max_gap_days) & (gap("d1", "z_pos") <= max_gap_days) & (F.col("ntd") >= min_trading_days))
    at = lambda pos: F.get("_v", pos - 1)
    a, z = F.col("a_pos"), F.col("z_pos")
    p = F.array(*(at(a + F.bround(F.lit(k / points) * F.col("ntd")).cast("int")) - at(a) for k in range(1, points + 1)))
    q = F.array(*(at(z + k) - at(z) for k in range(1, post_days + 1)))
    out = two.select("pair_id", "ntd", p.alias("p"), q.alias("q"), (at(z) - at(z - 20)).alias("pre20"))
    out = out.withColumn("pre", F.get("p", F.lit(points - 1))).withColumn("post", F.get("q", F.lit(post_days - 1)))
    # both anchors must have a benchmark: then the last p is known
    return out.where("pre is not null")


def path_between(pairs: DataFrame, bars: DataFrame, bench: DataFrame, points: int = 10, post_days: int = 20, min_trading_days: int = 20, max_gap_days: int = 7, min_bars: int = 60) -> DataFrame:
    """pairs (pair_id, ticker, d0, d1) -> (pair_id, ntd, leg, k, v) long: leg p at equal fractions
    of the trading days between the anchors (positions rounded half to even), leg q daily after
    d1, and pre20, pre, post, total (k null). Log returns minus the benchmark's.

    d0's base is the last close on or before it, d1's the last one strictly before."""
    wide = paths_between(pairs, bars, bench, points, post_days, min_trading_days, max_gap_days, min_bars)
    of = lambda leg, k, v: F.struct(F.lit(leg).alias("leg"), F.lit(k).cast("int").alias("k"), v.alias("v"))
    legs = [of(c, k, F.col(c)[k - 1]) for c, n in (("p", points), ("q", post_days)) for k in range(1, n + 1)]
    legs += [of(c, None, F.col(c)) for c in ("pre20", "pre", "post")] + [of("total", None, F.col("pre") + F.col("post"))]
    return wide.select("pair_id", "ntd", F.explode(F.array(*legs)).alias("s")).select("pair_id", "ntd", "s.*")


def segment_returns(events: DataFrame, bars: DataFrame, bench: DataFrame, segments: dict[str, tuple[int, int]], anchor_shift: int = 0, max_stale_days: int = 14, edge_slack_days: int = 0) -> DataFrame:
    """events (event_id, ticker, day) -> (event_id, segment, raw, bench, adj, end_date, anchor_used).

    Each segment compounds off its own start. Day 0 is the last close strictly before the
    anchor, other days the last on or before; days past the series' last bar plus the slack are
    null. The benchmark is read at the very dates that priced the ends. Events whose base is
    missing or stale, or whose series has under 30 bars, have no rows."""
    pos, n = positioned(bars), series(bars).select("ticker", "n_bars", "last_bar")
    own = events.withColumn("anchor_used", F.date_add("day", anchor_shift)).join(n, "ticker").where(F.col("n_bars") >= MIN_BARS)
    own = lookup(pos, own, "anchor_used", "<", "b_").where(F.datediff("anchor_used", "b_date") <= max_stale_days)
    days = sorted({d for s in segments.values() for d in s} - {0})
    grid = own.withColumn("d", F.explode(F.array(*map(F.lit, days)))).withColumn("grid", F.expr("date_add(anchor_used, d)"))
    inside = F.col("grid") <= F.date_add("last_bar", edge_slack_days)
    at = lookup(pos, grid, "grid", "<=", "e_").select("event_id", "d", *(F.when(inside, F.col(c)).alias(c[2:]) for c in ("e_date", "e_close")))
    at = at.unionByName(own.select("event_id", F.lit(0).alias("d"), F.col("b_date").alias("date"), F.col("b_close").alias("close")))
    at = at.join(F.broadcast(calendar(bars, bench)), "date", "left")
    prices = at.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct("d", F.struct("date", "close", "bench")))).alias("px"))
    rows = own.select("event_id", "anchor_used").join(prices, "event_id")
    segs = F.array(*(F.struct(F.lit(k).alias("segment"), F.col("px")[lo].alias("a"), F.col("px")[hi].alias("z")) for k, (lo, hi) in segments.items()))
    rows = rows.select("event_id", "anchor_used", F.explode(segs).alias("s"))
    raw, ben = F.col("s.z.close") / F.col("s.a.close") - 1, F.col("s.z.bench") / F.col("s.a.bench") - 1
    return rows.select("event_id", "s.segment", raw.alias("raw"), ben.alias("bench"), (raw - ben).alias("adj"), F.col("s.z.date").alias("end_date"), "anchor_used")


def segment_name(lo: int, hi: int) -> str:
    return f"s_{lo}_{hi}"


