"""Price, path and event-time queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import returns as T
from ..operators import survival as S
from ..sources import views as V
from .panel_queries import DEC_S, R, dec_s

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn

    return keep


def _more(*names: str) -> str:
    return ", " + ", ".join(V.SQL[n] for n in names)


_SER = "pos as (select ticker, date, close, row_number() over (partition by ticker order by date)::int as pos from bars), ser as (select ticker, count(*) n_bars, min(date) first_bar, max(date) last_bar from bars group by 1)"
_PATHS = (
    DEC_S + _more("bars") + ", " + _SER + """, e as (select cik as entry_id, ticker, as_of_date, year, listed_until from dec),
 p as (select e.*, k, (as_of_date + to_months(k::int))::date as day from e, range(0, 13) t(k)),
 h as (select p.*, b.date, b.close, n_bars, last_bar from p asof left join bars b on p.ticker = b.ticker and p.day >= b.date join ser s on s.ticker = p.ticker),
 e0 as (select entry_id, year, close as p0 from h where k = 0 and day - date <= 14 and close > 0 and n_bars >= 30),
 r as (select h.entry_id, h.ticker, h.year, h.k::int as k, case when not (day > last_bar + 45 or coalesce(day > listed_until, false)) then close / p0 - 1 end as r,
 (as_of_date + to_months(12))::date > last_bar or coalesce((as_of_date + to_months(12))::date > listed_until, false) as delisted_in_window from h join e0 on h.entry_id = e0.entry_id and h.year = e0.year where k > 0),
 paths as (select *, r - median(r) over (partition by year, k) as x from r)"""
)


def paths(spark: SparkSession, d: str) -> DataFrame:
    e = dec_s(spark, d).select(F.concat_ws("|", "cik", "year").alias("entry_id"), "ticker", "as_of_date", "year", "listed_until")
    return T.forward_paths(e, V.bars(spark, d), 12)


@query("e1_forward_paths", _PATHS + " select entry_id || '|' || year as entry_id, k, round(r, 9) as r, round(x, 9) as x, delisted_in_window from paths")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return paths(spark, d).select("entry_id", "k", R("r", 9).alias("r"), R("x", 9).alias("x"), "delisted_in_window")


_KM = _PATHS + """, lab as (select cik, year, (case when altman_z is null then 'none' when altman_z < 1 then 'low' else 'high' end) as label from dec),
 t as (select label, paths.entry_id, paths.year, min(k) filter (where r <= -0.3) as fail, coalesce(max(k) filter (where r is not null), 0) as last from paths join lab on lab.cik = paths.entry_id and lab.year = paths.year group by 1, 2, 3),
 g as (select label, k from (select distinct label from t), range(1, 13) u(k)),
 c as (select g.label, g.k::int as k, count(*) filter (where coalesce(fail, last) >= k) as at_risk, count(*) filter (where fail = k) as failures from g join t using (label) group by 1, 2),
 f as (select *, case when at_risk = 0 then 1.0::double else 1 - failures / at_risk end as step from c),
 km as (select label, k, at_risk, failures, 1 - product(step) over (partition by label order by k) as incidence from f)"""


def survival(spark: SparkSession, d: str) -> DataFrame:
    lab = dec_s(spark, d).select(F.concat_ws("|", "cik", "year").alias("entry_id"), F.when(F.col("altman_z").isNull(), "none").when(F.col("altman_z") < 1, "low").otherwise("high").alias("label"))
    t = S.failure_times(paths(spark, d).join(lab, "entry_id"), ["label", "entry_id"], "r", -0.3)
    return S.kaplan_meier(t, 12, ["label"])


@query("slice0_survival_by_label", _KM + " select label, k, at_risk, failures, round(incidence, 9) as incidence from km")
def slice0(spark: SparkSession, d: str) -> DataFrame:
    return survival(spark, d).select("label", "k", "at_risk", "failures", R("incidence", 9).alias("incidence"))


@query("v4_crossing", _KM + " select label, min(k) filter (where incidence >= 0.2 - 1e-12) as month from km group by 1")
def v4(spark: SparkSession, d: str) -> DataFrame:
    return S.crossing(survival(spark, d), 0.2 - 1e-12, ["label"])


@query("j3_close_at", DEC_S + _more("bars") + " select cik, year, case when as_of_date - date <= 14 then close end as px from dec asof left join bars on dec.ticker = bars.ticker and dec.as_of_date >= bars.date")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return A.close_at(V.bars(spark, d), dec_s(spark, d).select("cik", "year", "ticker", "as_of_date"), day="as_of_date").select("cik", "year", "px")


@query("j4_before_and_after", V.with_views("bars", "event_days") + ", " + _SER + """ select e.event_id, b.date as before, b.pos as before_pos, a.date as after, a.pos as after_pos from event_days e asof left join pos b on e.ticker = b.ticker and e.day > b.date asof left join pos a on e.ticker = a.ticker and e.day <= a.date""")
def j4(spark: SparkSession, d: str) -> DataFrame:
    pos = A.positioned(V.bars(spark, d))
    out = A.lookup(pos, A.lookup(pos, V.event_days(spark, d), side="<", prefix="b_"), side=">=", prefix="a_")
    return out.select("event_id", F.col("b_date").alias("before"), F.col("b_pos").alias("before_pos"), F.col("a_date").alias("after"), F.col("a_pos").alias("after_pos"))


@query("j5_forward_returns", DEC_S + _more("bars") + """, s as (select cik, year, ticker, as_of_date as st from dec), a as (select s.*, b.date as d0, b.close as c0 from s asof left join bars b on s.ticker = b.ticker and s.st >= b.date), z as (select a.*, a.st + 365 as en from a), y as (select z.*, b.date as d1, b.close as c1 from z asof left join bars b on z.ticker = b.ticker and z.en >= b.date)
 select cik, year, case when st - d0 <= 14 and en - d1 <= 45 and d0 < d1 and c0 > 0 then round(c1 / c0 - 1, 9) end as ret from y""")
def j5(spark: SparkSession, d: str) -> DataFrame:
    starts = dec_s(spark, d).select(F.concat_ws("|", "cik", "year").alias("start_id"), "ticker", F.col("as_of_date").alias("start"), "cik", "year")
    return A.forward_return(V.bars(spark, d), starts, 365).select("cik", "year", R("ret", 9).alias("ret"))


@query("j6_benchmark_returns", V.with_views("bench", "event_days") + """, s as (select distinct day from event_days), a as (select s.day, b.close c0 from s asof left join bench b on s.day >= b.date), z as (select a.*, (day + interval 6 month)::date as en from a), y as (select z.*, b.date d1, b.close c1 from z asof left join bench b on z.en >= b.date) select day, case when en - d1 <= 45 and c0 > 0 then round(c1 / c0 - 1, 9) end as bench_ret from y""")
def j6(spark: SparkSession, d: str) -> DataFrame:
    starts = V.event_days(spark, d).select(F.col("day").alias("start"), F.col("day").alias("start_id")).distinct()
    return A.benchmark_return(V.bench(spark, d), starts, 6).select(F.col("start").alias("day"), R("bench_ret", 9).alias("bench_ret"))


@query("j8_trading_day_shift", V.with_views("bars", "event_days") + ", " + _SER + """, x as (select *, (day(day) % 7 - 3)::int as k from event_days), y as (select x.*, a.pos ap, b.pos bp from x asof left join pos a on x.ticker = a.ticker and x.day <= a.date asof left join pos b on x.ticker = b.ticker and x.day >= b.date)
 select event_id, y.k, case when y.k = 0 then y.day else p.date end as shifted from y left join pos p on p.ticker = y.ticker and p.pos = case when y.k > 0 then ap + y.k when y.k < 0 then bp + y.k end""")
def j8(spark: SparkSession, d: str) -> DataFrame:
    x = V.event_days(spark, d).withColumn("k", F.dayofmonth("day") % 7 - 3)
    return A.shift_trading_days(V.bars(spark, d), x).select("event_id", "k", "shifted")


@query("j10_coverage", DEC_S + _more("bars") + ", " + _SER + """, x as (select year, ser.ticker is not null as priced, coalesce(n_bars >= 30, false) and as_of_date - date <= 14 as usable from dec asof left join bars on dec.ticker = bars.ticker and dec.as_of_date >= bars.date left join ser on ser.ticker = dec.ticker)
 select coalesce(year::varchar, 'all') as year, count(*) as n, round(avg(priced::int), 9) as nominal, round(avg(coalesce(usable, false)::int), 9) as usable from x group by rollup (year)""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    b = V.bars(spark, d)
    x = A.fresh_close_flags(b, A.priced_flags(b, dec_s(spark, d).select("ticker", "year", "as_of_date")))
    g = x.rollup("year").agg(F.count("*").alias("n"), R(F.avg(F.col("priced").cast("double")), 9).alias("nominal"), R(F.avg(F.col("usable").cast("double")), 9).alias("usable"))
    return g.withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("all")))


@query("j15_series_facts", V.with_views("panel_s", "bars") + ", " + _SER + """, f as (select max(date) mx from bars), g as (select ticker, max(listed_until) lu, max(as_of_date) lr from panel_s group by 1) select g.ticker, first_bar, last_bar, first_bar > lu as begins_after_end, first_bar <= lu and last_bar > lu as spans_end, last_bar >= mx - 30 as to_file_edge from g left join ser using (ticker), f where lu is not null""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    b = V.bars(spark, d)
    edge = b.agg(F.max("date").alias("mx"))
    g = V.panel_s(spark, d).groupBy("ticker").agg(F.max("listed_until").alias("lu")).where("lu is not null").join(A.series(b), "ticker", "left").crossJoin(F.broadcast(edge))  # one row
    return g.select("ticker", "first_bar", "last_bar", (F.col("first_bar") > F.col("lu")).alias("begins_after_end"), F.expr("first_bar <= lu and last_bar > lu").alias("spans_end"), F.expr("last_bar >= date_sub(mx, 30)").alias("to_file_edge"))


_EV = V.with_views("bars", "bench", "event_days") + ", " + _SER + """, an as (select e.event_id, e.ticker, e.day, b.date b_date, b.close b_close, b.pos b_pos, a.pos f_pos from event_days e asof left join pos b on e.ticker = b.ticker and e.day > b.date asof left join pos a on e.ticker = a.ticker and e.day <= a.date),
 tgt as materialized (select event_id, ticker, day, b_close, o, (f_pos + o)::int as pos from an join ser using (ticker), (select unnest([1, 5, 20]) o) where an.day - b_date <= 7 and n_bars >= f_pos + 20),
 ew as (select event_id, day, o as "offset", close / b_close - 1 as ret from tgt join pos using (ticker, pos))"""


@query("e2_event_window", _EV + ' select event_id, "offset", round(ret, 9) as ret from ew')
def e2(spark: SparkSession, d: str) -> DataFrame:
    return T.event_window(V.event_days(spark, d), V.bars(spark, d)).select("event_id", "offset", R("ret", 9).alias("ret"))


@query("e3_abnormal_window", _EV + """, bp as (select date, close, row_number() over (order by date)::int pos from bench), ds as (select distinct day from event_days), ba as (select ds.day, b.date b_date, b.close b_close, a.pos f_pos from ds asof left join bp b on ds.day > b.date asof left join bp a on ds.day <= a.date),
 bw as (select ba.day, o, p.close / b_close - 1 as bret from ba, (select unnest([1, 5, 20]) o) join bp p on p.pos = f_pos + o where ba.day - b_date <= 7 and f_pos + 20 <= (select count(*) from bench)) select event_id, "offset", round(ret - bret, 9) as ar from ew join bw on bw.day = ew.day and bw.o = ew."offset" """)
def e3(spark: SparkSession, d: str) -> DataFrame:
    return T.abnormal_window(V.event_days(spark, d), V.bars(spark, d), V.bench(spark, d)).select("event_id", "offset", R("ar", 9).alias("ar"))


_CAL = V.with_views("bars", "bench", "event_days") + """, cal as (select d.date, b.close as bench from (select distinct date from bars) d asof left join bench b on d.date >= b.date), pos as (select ticker, bars.date, close, bench, row_number() over (partition by ticker order by bars.date)::int as pos from bars join cal on cal.date = bars.date where bench is not null)"""


@query("e4_abnormal_path", _CAL + """, an as (select e.event_id, e.ticker, e.day, b.date b_date, b.close b_close, b.bench b_bench, b.pos b_pos, a.pos f_pos from event_days e asof left join pos b on e.ticker = b.ticker and e.day > b.date asof left join pos a on e.ticker = a.ticker and e.day <= a.date where e.day is not null)
, tgt as materialized (select event_id, ticker, b_close, b_bench, o::int as "offset", (case when o >= 0 then f_pos + o else b_pos + 1 + o end)::int as pos from an, range(-3, 4) t(o) where an.day - b_date <= 7)
 select event_id, "offset", round(close / b_close - bench / b_bench, 9) as ar from tgt left join pos using (ticker, pos)""")
def e4(spark: SparkSession, d: str) -> DataFrame:
    return T.abnormal_path(V.event_days(spark, d), V.bars(spark, d), V.bench(spark, d), -3, 3).select("event_id", "offset", R("ar", 9).alias("ar"))


_DA = _CAL + """, ar as (select ticker, pos, (close / lag(close) over (partition by ticker order by pos) - 1) - (bench / lag(bench) over (partition by ticker order by pos) - 1) as ar from pos), an as (select e.event_id, e.ticker, a.pos f_pos from event_days e asof join pos a on e.ticker = a.ticker and e.day <= a.date),
 x as (select event_id, o::int as "offset", ar.ar from an join range(-10, 4) t(o) on true join ar on ar.ticker = an.ticker and ar.pos = f_pos + o where ar.ar is not null), full_ as (select * from x where event_id in (select event_id from x group by 1 having count(*) = 14))"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    return T.daily_abnormal(V.event_days(spark, d), V.bars(spark, d), V.bench(spark, d), -10, 3)


@query("e5_daily_abnormal", _DA + ' select event_id, "offset", round(ar, 9) as ar from full_')
def e5(spark: SparkSession, d: str) -> DataFrame:
    return daily(spark, d).select("event_id", "offset", R("ar", 9).alias("ar"))


@query("a22_quiet_ratio", _DA + ' select round(median(abs(ar)) filter (where "offset" = 0) / median(abs(ar)) filter (where abs("offset") >= 6), 9) as ratio from full_')
def a22(spark: SparkSession, d: str) -> DataFrame:
    return T.med_abs_ratio(daily(spark, d)).select(R("ratio", 9).alias("ratio"))


@query("e7b_large_moves", _DA + """, w as (select event_id, max(abs(ar)) filter (where "offset" = 0) a0, max(abs(ar)) filter (where "offset" = 1) a1 from full_ group by 1) select count(*) as n, round(avg((a0 > 0.05)::int), 9) as large_on_day, round(avg((a1 > a0)::int), 9) as larger_next_day from w""")
def e7b(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.max(F.when(F.col("offset") == k, F.abs("ar")))
    w = daily(spark, d).groupBy("event_id").agg(at(0).alias("a0"), at(1).alias("a1"))
    return w.agg(F.count("*").alias("n"), R(F.avg((F.col("a0") > 0.05).cast("double")), 9).alias("large_on_day"), R(F.avg((F.col("a1") > F.col("a0")).cast("double")), 9).alias("larger_next_day"))


@query("a28_own_quiet_band", _DA + """, q as (select event_id, median(abs(ar)) filter (where "offset" <= -6) quiet, max(abs(ar)) filter (where "offset" = 0) a0 from full_ group by 1), c as (select split_part(event_id, '|', 1) as ticker, a0 / nullif(quiet, 0) as ratio from q) select (substr(ticker, 2)::bigint % 5)::int as class, count(*) as n, count(distinct ticker) as firms, case when count(*) >= 20 and count(distinct ticker) >= 2 then round(median(ratio), 9) end as median_ratio from c group by 1""")
def a28(spark: SparkSession, d: str) -> DataFrame:
    q = daily(spark, d).groupBy("event_id").agg(F.median(F.when(F.col("offset") <= -6, F.abs("ar"))).alias("quiet"), F.max(F.when(F.col("offset") == 0, F.abs("ar"))).alias("a0"))
    c = q.select(F.split("event_id", r"\|")[0].alias("ticker"), F.try_divide("a0", "quiet").alias("ratio"))
    g = c.groupBy(F.pmod(F.expr("cast(substr(ticker, 2) as long)"), F.lit(5)).cast("int").alias("class")).agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("firms"), F.median("ratio").alias("m"))
    return g.select("class", "n", "firms", F.when(F.expr("n >= 20 and firms >= 2"), R("m", 9)).alias("median_ratio"))


_PB = V.with_views("bars", "bench", "event_days") + """, pos as (select ticker, date, close, row_number() over (partition by ticker order by date)::int as pos from bars), ser as (select ticker, count(*) n_bars from bars group by 1),
 cal as (select d.date, b.close as bench from (select distinct date from bars) d asof left join bench b on d.date >= b.date), lg as (select ticker, pos, ln(close) - ln(bench) as v from pos left join cal on cal.date = pos.date),
 pr as (select ticker, event_id as pair_id, day as d0, lead(day, 6) over (partition by ticker order by day) as d1 from event_days), p2 as (select * from pr where d1 is not null),
 tw as (select p2.*, a.date a_date, a.pos a_pos, z.date z_date, z.pos z_pos, n_bars from p2 asof join pos a on p2.ticker = a.ticker and p2.d0 >= a.date asof join pos z on p2.ticker = z.ticker and p2.d1 > z.date join ser on ser.ticker = p2.ticker),
 ok as (select * from tw where n_bars >= 60 and d0 - a_date <= 7 and d1 - z_date <= 7 and z_pos - a_pos >= 20)"""


@query("e6_path_between", _PB + """ select pair_id, (z_pos - a_pos)::int as ntd, round(z.v - a.v, 9) as pre, round(q.v - z.v, 9) as post, round(h.v - a.v, 9) as p_5 from ok join lg a on a.ticker = ok.ticker and a.pos = a_pos join lg z on z.ticker = ok.ticker and z.pos = z_pos left join lg q on q.ticker = ok.ticker and q.pos = z_pos + 20 left join lg h on h.ticker = ok.ticker and h.pos = a_pos + round_even(0.5 * (z_pos - a_pos), 0)::int where z.v is not null and a.v is not null""")
def e6(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    ev = V.event_days(spark, d)
    pairs = ev.select("ticker", F.col("event_id").alias("pair_id"), F.col("day").alias("d0"), F.lead("day", 6).over(Window.partitionBy("ticker").orderBy("day")).alias("d1")).where("d1 is not null")
    rows = T.paths_between(pairs, V.bars(spark, d), V.bench(spark, d))
    return rows.select("pair_id", "ntd", R("pre", 9).alias("pre"), R("post", 9).alias("post"), R(F.col("p")[4], 9).alias("p_5"))


SEGMENTS = {"s_-30_0": (-30, 0), "s_0_30": (0, 30), "s_30_90": (30, 90)}


@query("e7_segment_returns", V.with_views("bars", "bench", "event_days") + """, ser as (select ticker, count(*) n_bars, max(date) last_bar from bars group by 1), cal as (select d.date, b.close as bench from (select distinct date from bars) d asof left join bench b on d.date >= b.date),
 own as (select e.*, b.date b_date, b.close b_close, last_bar from event_days e asof left join bars b on e.ticker = b.ticker and e.day > b.date join ser on ser.ticker = e.ticker where n_bars >= 30), ok as (select * from own where day - b_date <= 14),
 g as (select ok.*, d, day + d as grid from ok, (select unnest([-30, 30, 90])::int d)), at0 as (select g.event_id, d, last_bar, grid, b.date, b.close from g asof left join bars b on g.ticker = b.ticker and g.grid >= b.date),
 at1 as (select event_id, d, case when grid <= last_bar then date end as date, case when grid <= last_bar then close end as close from at0 union all select event_id, 0, b_date, b_close from ok), at2 as (select at1.*, bench from at1 left join cal on cal.date = at1.date),
 sg as (select * from (values ('s_-30_0', -30, 0), ('s_0_30', 0, 30), ('s_30_90', 30, 90)) t(segment, lo, hi))
 select a.event_id, segment, round(z.close / a.close - 1, 9) as raw, round((z.close / a.close - 1) - (z.bench / a.bench - 1), 9) as adj, z.date as end_date from sg join at2 a on a.d = lo join at2 z on z.d = hi and z.event_id = a.event_id""")
def e7(spark: SparkSession, d: str) -> DataFrame:
    out = T.segment_returns(V.event_days(spark, d), V.bars(spark, d), V.bench(spark, d), SEGMENTS)
    return out.select("event_id", "segment", R("raw", 9).alias("raw"), R("adj", 9).alias("adj"), "end_date")


@query("w4_split_scan", V.with_views("bars") + """, x as (select ticker, date, close, lag(close) over (partition by ticker order by date) prev from bars where date >= date '1996-01-01') select ticker, date, prev, close, round(close / prev, 9) as ratio from x where prev > 0 and (close / prev < 0.6 or close / prev > 1.6)""")
def w4(spark: SparkSession, d: str) -> DataFrame:
    return A.split_scan(V.bars(spark, d), F.to_date(F.lit("1996-01-01")), 0.6, 1.6).withColumn("ratio", R("ratio", 9))


@query("j22_panel_row_in_force", V.with_views("panel_s", "event_days") + """ select e.event_id, p.as_of_date, p.fiscal_year, p.altman_z from event_days e asof left join panel_s p on e.ticker = p.ticker and e.day > p.as_of_date""")
def j22(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_s(spark, d)
    days = A.positioned(p.select("ticker", F.col("as_of_date").alias("date"), F.lit(0.0).alias("close")))
    last = A.lookup(days, V.event_days(spark, d), "day", "<").select("event_id", "ticker", F.col("date").alias("as_of_date"))
    return last.join(p.select("ticker", "as_of_date", "fiscal_year", "altman_z"), ["ticker", "as_of_date"], "left").drop("ticker")


@query("u2_symbol_reuse", V.with_views("panel_s", "bars") + """, ended as (select ticker, max(listed_until) lu from panel_s where listed_until is not null group by 1) select e.ticker, count(*) as bars_after from ended e join bars b on b.ticker = e.ticker and b.date > lu group by 1""")
def u2(spark: SparkSession, d: str) -> DataFrame:
    e = V.panel_s(spark, d).where("listed_until is not null").groupBy("ticker").agg(F.max("listed_until").alias("lu"))
    return V.bars(spark, d).join(e, "ticker").where("date > lu").groupBy("ticker").agg(F.count("*").alias("bars_after"))


@query("a38_return_test", DEC_S + _more("bars") + """, s as (select cik, year, ticker, health_score, as_of_date as st from dec), a as (select s.*, b.date as d0, b.close as c0 from s asof left join bars b on s.ticker = b.ticker and s.st >= b.date), z as (select a.*, a.st + 365 as en from a), y as (select z.*, b.date as d1, b.close as c1 from z asof left join bars b on z.ticker = b.ticker and z.en >= b.date),
 t as (select *, case when st - d0 <= 14 and en - d1 <= 45 and d0 < d1 and c0 > 0 then c1 / c0 - 1 end as ret from y), u as (select *, ret - median(ret) over (partition by year) as adj, row_number() over (partition by year order by health_score, cik) rn, count(*) over (partition by year) n from t),
 q as (select *, greatest(1, least(5, ceil(rn::double / n * 5)))::int as bin from u where n >= 5) select bin, count(adj) as n, round(avg(adj), 9) as mean_adj, round(median(adj), 9) as median_adj, round(avg(coalesce(adj < -0.2, false)::int), 9) as tail from q group by 1""")
def a38(spark: SparkSession, d: str) -> DataFrame:
    """Forward returns, adjusted by year, read by quintile of a metric; a missing return is not in the tail, but counts below it."""
    from ..operators.panel import market_adjust, qcut_within

    starts = dec_s(spark, d).select(F.concat_ws("|", "cik", "year").alias("start_id"), "ticker", F.col("as_of_date").alias("start"), "cik", "year", "health_score")
    rows = market_adjust(A.forward_return(V.bars(spark, d), starts, 365), ["ret"], ["year"])
    rows = qcut_within(rows, "health_score", "year", ["cik"], 5, 1).where("bin is not null")
    tail = F.coalesce(F.col("ret_adj") < -0.2, F.lit(False)).cast("double")
    return rows.groupBy("bin").agg(F.count("ret_adj").alias("n"), R(F.avg("ret_adj"), 9).alias("mean_adj"), R(F.median("ret_adj"), 9).alias("median_adj"), R(F.avg(tail), 9).alias("tail"))
