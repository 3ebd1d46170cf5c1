"""Study jobs: compositions of the operators, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..operators import asof as A
from ..operators import matching as M
from ..operators import panel as P
from ..operators import resample as B
from ..operators import returns as T
from ..operators import shares as S
from ..operators.ranks import ranked
from ..operators.variance import spearman
from ..sources import views as V
from .null_queries import CELLS, DRAWS, _cases, _did, _h, recursive
from .panel_queries import _VINT, DEC_S, EXIT, UNI_C, R, dec_s
from .price_queries import _DA
from .share_queries import _CAP, _CORR, flags

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn

    return keep


def share(c):
    """The share of rows where c holds; missing counts as not."""
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


@query("a16_sector_pool", UNI_C + """, l as (select cik, arg_max(sector, qi) sector, arg_max(revenue, qi) revenue, max(qi) = (select max(qi) from uni) as present from uni group by 1), k as (select * from l where revenue >= 50000), t as (select *, least(3, ((row_number() over (partition by present order by revenue, cik) - 1) * 3) // count(*) over (partition by present) + 1)::int as tercile from k)
 select coalesce(sector, 'all') as sector, tercile, count(*) as firms, round(avg(present::int), 8) as present_share from t group by grouping sets ((sector, tercile), (tercile))""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    u = P.universe(V.panel_c(spark, d))
    last = u.agg(F.max("qi").alias("edge"))
    rows = u.groupBy("cik").agg(F.max_by("sector", "qi").alias("sector"), F.max_by("revenue", "qi").alias("revenue"), F.max("qi").alias("last_qi")).crossJoin(F.broadcast(last)).withColumn("present", F.col("last_qi") == F.col("edge"))  # one row
    t = P.tercile(rows.where("revenue >= 50000"), "revenue", ["present"], ["cik"])
    by = t.groupBy("sector", "tercile").agg(F.count("*").alias("firms"), R(share(F.col("present")), 8).alias("present_share"))
    every = t.groupBy("tercile").agg(F.count("*").alias("firms"), R(share(F.col("present")), 8).alias("present_share")).withColumn("sector", F.lit("all"))
    return by.unionByName(every)


@query("a17_crosstab", UNI_C + """, y as (select cik, year(as_of_date)::int as year, sector from uni), c as (select sector, year, count(*) n from y group by 1, 2) select sector, round(100.0::double * sum(n) filter (where year = 1997) / sum(n), 8) as y1997, round(100.0::double * sum(n) filter (where year = 1998) / sum(n), 8) as y1998, round(100.0::double * sum(n) filter (where year = 1999) / sum(n), 8) as y1999 from c group by 1""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    y = P.universe(V.panel_c(spark, d)).select("sector", F.year("as_of_date").alias("year"))
    table = y.groupBy("sector").pivot("year", [1997, 1998, 1999]).count().join(y.groupBy("sector").agg(F.count("*").alias("n")), "sector")
    return table.select("sector", *(R(100.0 * F.col(str(k)) / F.col("n"), 8).alias(f"y{k}") for k in (1997, 1998, 1999)))


@query("a20_metric_coverage", V.with_views("panel_s") + """ select sector, round(avg((altman_z is not null)::int), 8) as altman_z, round(avg((gross_margin is not null)::int), 8) as gross_margin, avg((altman_z is not null)::int) = 0 as z_never from panel_s group by 1""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    has = lambda c: share(F.col(c).isNotNull())
    return V.panel_s(spark, d).groupBy("sector").agg(R(has("altman_z"), 8).alias("altman_z"), R(has("gross_margin"), 8).alias("gross_margin"), (has("altman_z") == 0).alias("z_never"))


@query("a23_staleness", V.with_views("panel_s") + """, s as (select cik, as_of_date, (as_of_date - min(as_of_date) over (partition by cik, fiscal_year)) as days from panel_s), b as (select least(8, round_even(days / 91.31, 0)::int) as stale_quarters from s) select stale_quarters, count(*) as n from b group by 1""")
def a23(spark: SparkSession, d: str) -> DataFrame:
    s = P.record_refresh_events(V.panel_s(spark, d), events_only=False)
    return s.groupBy(F.least(F.lit(8), F.bround(F.col("fy_age_days") / 91.31).cast("int")).alias("stale_quarters")).agg(F.count("*").alias("n"))


@query("a25_zero_changes", V.with_views("panel_s") + """, g as (select cik, max(qi) qi from panel_s group by 1), w as (select g.cik, k::int as k, p.fiscal_year fy, p.piotroski ps, b.fiscal_year fy0, b.piotroski ps0 from g cross join range(-7, 0) t(k) join panel_s p on p.cik = g.cik and p.qi = g.qi + k join panel_s b on b.cik = g.cik and b.qi = g.qi - 8), l as (select k, 'fiscal_year' as metric, (fy - fy0)::double as ch from w union all select k, 'piotroski', (ps - ps0)::double from w) select metric, k, count(*) as n, round(avg((ch = 0)::int), 8) as zero from l group by 1, 2""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_s(spark, d)
    an = p.groupBy("cik").agg(F.max("qi").alias("qi")).withColumn("aid", F.col("cik").cast("string"))
    long = M.trajectories(an, p, ["fiscal_year", "piotroski"]).where("k > -8 and change is not null")
    return long.groupBy("metric", "k").agg(F.count("*").alias("n"), R(share(F.col("change") == 0), 8).alias("zero"))


@query("a30_screens_by_vintage", _VINT + """ select round(count(*) filter (where qa = 5 and qb = 5)::double / count(*) filter (where qa = 5 or qb = 5), 8) as jaccard, count(*) filter (where qa = 5 and qb <> 5) as first_only, count(*) filter (where qb = 5 and qa <> 5) as last_only from q""")
def a30(spark: SparkSession, d: str) -> DataFrame:
    v = dec_s(spark, d).select("cik", "year", F.col("revenue").alias("first_value"), R(F.col("revenue") * (1 + 0.04 * ((F.col("cik") * 7 + F.col("year")) % 5 - 2)), 4).alias("last_value"))
    pick = lambda c: P.qcut_within(v, c, "year", ["cik"], 5, 1).where("bin = 5").select("cik", "year", F.lit(True).alias(c))
    both = pick("first_value").join(pick("last_value"), ["cik", "year"], "full")
    a, b = F.col("first_value").isNotNull(), F.col("last_value").isNotNull()
    return both.agg(R(F.count_if(a & b) / F.count("*"), 8).alias("jaccard"), F.count_if(a & ~b).alias("first_only"), F.count_if(b & ~a).alias("last_only"))


@query("a31_rank_correlation_by_year", DEC_S + """, r as (select year, rank() over (partition by year order by revenue) + (count(*) over (partition by year, revenue) - 1) / 2 as ra, rank() over (partition by year order by altman_z) + (count(*) over (partition by year, altman_z) - 1) / 2 as rb from dec where altman_z is not null) select year, count(*) as n, round(corr(ra, rb), 8) as rho from r group by 1""")
def a31(spark: SparkSession, d: str) -> DataFrame:
    return spearman(dec_s(spark, d), "revenue", "altman_z", ["year"]).select("year", "n", R("rho", 8).alias("rho"))


@query("a32_decile_spread_by_horizon", DEC_S + """, b as (select cik, year, revenue, row_number() over (partition by year order by health_score, cik) rn, count(*) over (partition by year) n from dec), q as (select *, greatest(1, least(5, ceil(rn::double / n * 5)))::int bin from b where n >= 5), f as (select q.cik, q.year, bin, q.revenue r0, a.revenue r1, c.revenue r2 from q join dec a on a.cik = q.cik and a.year = q.year + 1 join dec c on c.cik = q.cik and c.year = q.year + 2)
 select step, count(*) as n, round(median(g) filter (where bin = 5) - median(g) filter (where bin = 1), 8) as spread from (select 1 as step, bin, r1 / r0 - 1 as g from f union all select 2, bin, r2 / r0 - 1 from f) group by 1""")
def a32(spark: SparkSession, d: str) -> DataFrame:
    q = P.qcut_within(dec_s(spark, d), "health_score", "year", ["cik"], 5, 1).where("bin is not null").select("cik", "year", "bin", "revenue")
    later = lambda k: dec_s(spark, d).select("cik", (F.col("year") - k).alias("year"), F.col("revenue").alias(f"r{k}"))
    f = q.join(later(1), ["cik", "year"]).join(later(2), ["cik", "year"])  # the same firms at every step
    g = f.select("bin", F.explode(F.array(*(F.struct(F.lit(k).alias("step"), (F.col(f"r{k}") / F.col("revenue") - 1).alias("g")) for k in (1, 2)))).alias("s")).select("bin", "s.*")
    at = lambda b: F.median(F.when(F.col("bin") == b, F.col("g")))
    return g.groupBy("step").agg(F.count("*").alias("n"), R(at(5) - at(1), 8).alias("spread"))


@query("a34_end_date_against_last_row", EXIT + """, e as (select f.*, lu from firms f join (select cik, max(listed_until) lu from panel_s where listed_until is not null group by 1) using (cik)) select count(*) as n, round(avg((lu > last_row)::int), 8) as after_last_row, round(median((lu - last_row) / 91.31), 6) as quarters_after_row, round(quantile_cont((lu - last_refresh) / 91.31, 0.25), 6) as p25_after_refresh, round(quantile_cont((lu - last_refresh) / 91.31, 0.75), 6) as p75_after_refresh from e""")
def a34(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_s(spark, d)
    e = P.exit_frame(p).join(p.where("listed_until is not null").groupBy("cik").agg(F.max("listed_until").alias("lu")), "cik")
    q = lambda c: F.datediff("lu", c) / 91.31
    return e.agg(F.count("*").alias("n"), R(share(F.col("lu") > F.col("last_row")), 8).alias("after_last_row"), R(F.median(q("last_row")), 6).alias("quarters_after_row"), R(F.percentile(q("last_refresh"), 0.25), 6).alias("p25_after_refresh"), R(F.percentile(q("last_refresh"), 0.75), 6).alias("p75_after_refresh"))


@query("a37_quintile_outcomes", DEC_S + """, b as (select cik, year, operating_margin as m, row_number() over (partition by year order by health_score, cik) rn, count(*) over (partition by year) n from dec), q as (select *, greatest(1, least(5, ceil(rn::double / n * 5)))::int bin from b where n >= 5), o as (select bin, d.operating_margin - m as ch from q join dec d on d.cik = q.cik and d.year = q.year + 1 where d.fiscal_year >= (select fiscal_year + 1 from dec z where z.cik = q.cik and z.year = q.year)) select bin, count(*) as n, round(median(ch), 8) as median_change, round(avg((ch <= -0.02)::int), 8) as dropped from o group by 1""")
def a37(spark: SparkSession, d: str) -> DataFrame:
    q = P.qcut_within(dec_s(spark, d), "health_score", "year", ["cik"], 5, 1).where("bin is not null")
    o = P.transitions(q).withColumn("ch", F.col("operating_margin_next") - F.col("operating_margin"))
    return o.groupBy("bin").agg(F.count("*").alias("n"), R(F.median("ch"), 8).alias("median_change"), R(share(F.col("ch") <= -0.02), 8).alias("dropped"))


@query("a39_priced_share_by_quintile", DEC_S + ", " + V.SQL["bars"] + ", " + V.SQL["vendor_bars"] + """, b as (select cik, year, ticker, row_number() over (partition by year order by net_margin, cik) rn, count(*) over (partition by year) n from dec), q as (select *, greatest(1, least(5, ceil(rn::double / n * 5)))::int bin from b where n >= 5) select bin, count(*) as n, round(avg((ticker in (select ticker from vendor_bars))::int), 8) as priced from q group by 1""")
def a39(spark: SparkSession, d: str) -> DataFrame:
    q = A.priced_flags(V.vendor_bars(spark, d), P.qcut_within(dec_s(spark, d), "net_margin", "year", ["cik"], 5, 1).where("bin is not null"))
    return q.groupBy("bin").agg(F.count("*").alias("n"), R(share(F.col("priced")), 8).alias("priced"))


@query("a40_universe_counts", V.with_views("panel_s", "bars") + """, f as (select max(as_of_date) v from panel_s), g as (select cik, ticker, max(as_of_date) lr, max(listed_until) lu, count(*) n from panel_s group by 1, 2) select count(*) as firms, sum(n)::bigint as row_count, count(*) filter (where lr = v) as survivors, count(*) filter (where lr < v and lu is not null) as ended, count(*) filter (where lr < v and lu is null) as stopped, count(*) filter (where ticker in (select ticker from bars)) as with_series from g, f""")
def a40(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_s(spark, d)
    g = P.cohort_status(p).join(p.groupBy("cik").agg(F.max("ticker").alias("ticker"), F.count("*").alias("n")), "cik")
    g = A.priced_flags(V.bars(spark, d), g)
    of = lambda s: F.count_if(F.col("status") == s).alias({"present": "survivors"}.get(s, s))
    return g.agg(F.count("*").alias("firms"), F.sum("n").alias("row_count"), of("present"), of("ended"), of("stopped"), F.count_if(F.col("priced")).alias("with_series"))


@query("a42_restated_direction", _VINT + """, c as (select *, last_value > first_value as up, row_number() over (order by first_value, cik, year) rn, count(*) over () nn from v), t as (select *, least(4, ((rn - 1) * 4) // nn + 1) as quartile from c) select quartile::int as quartile, count(*) as n, round(avg(up::int) filter (where last_value <> first_value), 8) as p, round(avg(up::int) filter (where last_value <> first_value) - 1.96 * sqrt(avg(up::int) filter (where last_value <> first_value) * (1 - avg(up::int) filter (where last_value <> first_value)) / count(*) filter (where last_value <> first_value)), 8) as lo from t group by 1""")
def a42(spark: SparkSession, d: str) -> DataFrame:
    """Share restated higher among changed rows, by revenue quartile, with the binomial interval's lower end."""
    from ..operators.survival import binomial_interval

    v = dec_s(spark, d).select("cik", "year", F.col("revenue").alias("first_value"), R(F.col("revenue") * (1 + 0.04 * ((F.col("cik") * 7 + F.col("year")) % 5 - 2)), 4).alias("last_value"))
    w = Window.partitionBy()
    rank = F.row_number().over(w.orderBy("first_value", "cik", "year"))
    t = v.withColumn("quartile", F.least(F.lit(4), F.floor((rank - 1) * 4 / F.count("*").over(w)) + 1).cast("int")).withColumn("up", F.when(F.col("last_value") != F.col("first_value"), (F.col("last_value") > F.col("first_value")).cast("double")))
    g = t.groupBy("quartile").agg(F.count("*").alias("n"), F.avg("up").alias("p"), F.count("up").alias("k"))
    return g.select("quartile", "n", R("p", 8).alias("p"), R(binomial_interval(F.col("p"), F.col("k"))[0], 8).alias("lo"))


@query("a45_difference_in_differences", DEC_S + """, x as (select d.cik, d.piotroski < 4 as flagged, d.gross_margin > p.gross_margin as rose, n.net_margin - d.net_margin as ch from dec d join dec p on p.cik = d.cik and p.year = d.year - 1 join dec n on n.cik = d.cik and n.year = d.year + 1) select round((avg(ch) filter (where flagged and rose) - avg(ch) filter (where not flagged and rose)) - (avg(ch) filter (where flagged and not rose) - avg(ch) filter (where not flagged and not rose)), 9) as did, count(*) as n from x""")
def a45(spark: SparkSession, d: str) -> DataFrame:
    x = dec_s(spark, d).select("cik", "year", "piotroski", "gross_margin", "net_margin")
    prev = x.select("cik", (F.col("year") + 1).alias("year"), F.col("gross_margin").alias("g0"))
    then = x.select("cik", (F.col("year") - 1).alias("year"), F.col("net_margin").alias("m1"))
    x = x.join(prev, ["cik", "year"]).join(then, ["cik", "year"]).select((F.col("piotroski") < 4).alias("flagged"), (F.col("gross_margin") > F.col("g0")).alias("rose"), (F.col("m1") - F.col("net_margin")).alias("ch"))
    of = lambda c: F.avg(F.when(F.expr(c), F.col("ch")))
    did = (of("flagged and rose") - of("not flagged and rose")) - (of("flagged and not rose") - of("not flagged and not rose"))
    return x.agg(R(did, 9).alias("did"), F.count("*").alias("n"))


@query("e8_shift_curve", V.with_views("bars", "bench", "event_days") + """, ser as (select ticker, count(*) n_bars, max(date) last_bar from bars group by 1), cal as (select d.date, b.close as bench from (select distinct date from bars) d asof left join bench b on d.date >= b.date), sh as (select e.*, s::int as shift, e.day + s::int as au from event_days e, (select unnest([-5, 0, 5]) s)),
 own as (select sh.*, b.date bd, b.close bc, last_bar from sh asof left join bars b on sh.ticker = b.ticker and sh.au > b.date join ser on ser.ticker = sh.ticker where n_bars >= 30), ok as (select * from own where au - bd <= 14), en as (select ok.*, au + 30 as grid from ok), z as (select en.*, b.date zd, b.close zc from en asof left join bars b on en.ticker = b.ticker and en.grid >= b.date where grid <= last_bar),
 r as (select z.event_id, shift, (zc / bc - 1) - (c1.bench / c0.bench - 1) as adj from z join cal c0 on c0.date = bd join cal c1 on c1.date = zd), f as (select * from r where event_id in (select event_id from r where adj is not null group by 1 having count(*) = 3)) select shift, count(*) as n, round(avg(adj), 9) as mean_adj from f group by 1""")
def e8(spark: SparkSession, d: str) -> DataFrame:
    ev, b, m = V.event_days(spark, d), V.bars(spark, d), V.bench(spark, d)
    shifts = F.explode(F.array(*map(F.lit, (-5, 0, 5))))
    moved = ev.withColumn("shift", shifts).select(F.concat_ws("@", "event_id", "shift").alias("event_id"), "ticker", F.expr("date_add(day, shift)").alias("day"))
    r = T.segment_returns(moved, b, m, {"s_0_30": (0, 30)}).where("adj is not null").select(F.split("event_id", "@")[0].alias("event_id"), F.split("event_id", "@")[1].cast("int").alias("shift"), "adj")
    full = r.withColumn("k", F.count("*").over(Window.partitionBy("event_id"))).where("k = 3")
    return full.groupBy("shift").agg(F.count("*").alias("n"), R(F.avg("adj"), 9).alias("mean_adj"))


@query("w7_ninth_from_last", UNI_C + """, r as (select cik, qi, revenue, row_number() over (partition by cik order by qi desc) b, row_number() over (partition by cik order by qi) a from uni) select cik, max(qi) filter (where a = 1) as first_qi, max(qi) filter (where b = 1) as last_qi, max(revenue) filter (where b = 9) as ninth_from_last from r group by 1""")
def w7(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("cik")
    r = P.universe(V.panel_c(spark, d)).select("cik", "qi", "revenue", F.row_number().over(w.orderBy(F.desc("qi"))).alias("b"), F.row_number().over(w.orderBy("qi")).alias("a"))
    at = lambda c, k, v: F.max(F.when(F.col(c) == k, F.col(v)))
    return r.groupBy("cik").agg(at("a", 1, "qi").alias("first_qi"), at("b", 1, "qi").alias("last_qi"), at("b", 9, "revenue").alias("ninth_from_last"))


@query("w10_quiet_band_without_events", _DA + """, ev as (select an.ticker, an.f_pos from an), q as (select an.event_id, an.ticker, an.f_pos + x."offset" as pos, x.ar from an join full_ x on x.event_id = an.event_id where x."offset" <= -6) select q.event_id, count(*) as days, round(median(abs(ar)), 9) as quiet from q where (q.ticker, q.pos) not in (select (ticker, f_pos) from ev) group by 1""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = -10, -6
    rows = T.daily_windows(V.event_days(spark, d), V.bars(spark, d), V.bench(spark, d), lo, 3)
    near = F.collect_set("f_pos").over(Window.partitionBy("ticker").orderBy("f_pos").rangeBetween(lo, hi))  # five places at most
    rows = rows.withColumn("_near", near).where("ars is not null")
    quiet = F.filter(F.slice("ars", 1, hi - lo + 1), lambda x, i: ~F.array_contains("_near", F.col("f_pos") + lo + i))
    rows = rows.select("event_id", F.array_sort(F.transform(quiet, F.abs)).alias("_q")).withColumn("days", F.size("_q")).where("days > 0")
    middle = (F.get("_q", F.expr("(days - 1) div 2").cast("int")) + F.get("_q", F.expr("days div 2").cast("int"))) / 2
    return rows.select("event_id", F.col("days").cast("long").alias("days"), R(middle, 9).alias("quiet"))


@query("v11b_cap_continuity", _CAP + """, k as (select cik, fiscal_year, px, outstanding * px as cap from c where px is not null) select a.cik, a.fiscal_year, round((b.cap / a.cap) / (b.px / a.px), 8) as implied_growth from k a join k b on b.cik = a.cik and b.fiscal_year = a.fiscal_year + 1 where not ((b.cap / a.cap) / (b.px / a.px) between 0.5 and 2)""")
def v11b(spark: SparkSession, d: str) -> DataFrame:
    s = V.share_series(spark, d).withColumn("as_of", F.make_date("fiscal_year", F.lit(12), F.lit(31))).withColumn("ticker", F.concat(F.lit("S"), F.pmod("cik", F.lit(10))))
    k = A.close_at(V.bars(spark, d), s.select("cik", "fiscal_year", "outstanding", "ticker", "as_of"), day="as_of").where("px is not null").select("cik", "fiscal_year", "px", (F.col("outstanding") * F.col("px")).alias("cap"))
    nxt = k.select("cik", (F.col("fiscal_year") - 1).alias("fiscal_year"), F.col("px").alias("px1"), F.col("cap").alias("cap1"))
    g = (F.col("cap1") / F.col("cap")) / (F.col("px1") / F.col("px"))
    return k.join(nxt, ["cik", "fiscal_year"]).where(~g.between(0.5, 2)).select("cik", "fiscal_year", R(g, 8).alias("implied_growth"))


@query("v13_company_facts", _CORR + """, sp as (select cik, min(fiscal_year) first_fy, max(fiscal_year) last_fy, count(*) n_years from shares group by 1), sd as (select cik, count(*) n_disagree from shares where not (outstanding / diluted between 0.5 and 2) group by 1), fl as (select cik, count(*) n_flags, count(*) filter (where hit is not null) n_corroborated from g group by 1) select cik, first_fy, last_fy, n_years, coalesce(n_disagree, 0) as n_disagree, coalesce(n_flags, 0) as n_flags, coalesce(n_corroborated, 0) as n_corroborated from sp left join sd using (cik) left join fl using (cik)""")
def v13(spark: SparkSession, d: str) -> DataFrame:
    s = V.share_series(spark, d)
    checked = S.corroborate_flags(flags(spark, d), s.select("cik", "fiscal_year", F.col("outstanding").alias("shares")))
    span = s.groupBy("cik").agg(F.min("fiscal_year").alias("first_fy"), F.max("fiscal_year").alias("last_fy"), F.count("*").alias("n_years"))
    bad = S.series_sanity(s).groupBy("cik").agg(F.count("*").alias("n_disagree"))
    fl = checked.groupBy("cik").agg(F.count("*").alias("n_flags"), F.count_if(F.col("verdict") == "corroborated").alias("n_corroborated"))
    return span.join(bad, "cik", "left").join(fl, "cik", "left").na.fill(0, ["n_disagree", "n_flags", "n_corroborated"])


SEEDS = range(5)


def _seeded(seed: int) -> str:
    """The differences of the last quarter under another seed of the match and of the draws."""
    return f"select {seed} as seed, metric, obs, lo, hi from (" + recursive(_did(seed)).replace("where k > -4 and v is not null", "where k = -1 and v is not null") + " select * from did)"


@query("r17_seed_sensitivity", " union all ".join(map(_seeded, SEEDS)))
def r17(spark: SparkSession, d: str) -> DataFrame:
    """The matched draw under several seeds: changes over the quarters before the anchor, cases less controls."""
    cases, controls = _cases(spark, d)
    out = None
    for seed in SEEDS:
        pairs = M.matched_controls(cases, controls, ["qi", "tercile"], seed=seed).join(cases, "case_id")
        a = cases.select(F.concat(F.lit("a"), "case_id").alias("aid"), F.split("case_id", r"\|")[0].cast("long").alias("cik"), "qi", F.lit("a").alias("side"))
        b = pairs.select(F.concat_ws("|", F.lit("b"), "case_id", "control_id").alias("aid"), F.col("control_id").alias("cik"), "qi", F.lit("b").alias("side"))
        both = a.unionByName(b)
        long = M.trajectories(both, V.panel_c(spark, d), ["revenue", "n_orders"], -4, -1).where("k = -1").join(both.select("aid", "side", "cik"), "aid")
        gap = B.cluster_boot_diff(long, "change", "cik", "side", "mean", CELLS, seed, by=["metric"]).select(F.lit(seed).alias("seed"), "metric", *(R(c, 6).alias(c) for c in ("obs", "lo", "hi")))
        out = gap if out is None else out.unionByName(gap)
    return out


@query("r18_staleness_matched_gap", DEC_S + """, s as (select d.cik, d.year, d.net_margin, d.piotroski < 4 as flagged, least(3, (as_of_date - (select min(p.as_of_date) from panel_s p where p.cik = d.cik and p.fiscal_year = d.fiscal_year)) // 92) as stale from dec d), c as (select year, stale, avg(net_margin) filter (where flagged) a, avg(net_margin) filter (where not flagged) b, count(*) filter (where flagged) n from s group by 1, 2) select round(sum((a - b) * n) / sum(n), 9) as gap, count(*) as cells from c where a is not null and b is not null""")
def r18(spark: SparkSession, d: str) -> DataFrame:
    age = P.record_refresh_events(V.panel_s(spark, d), events_only=False).select("cik", "as_of_date", F.least(F.lit(3), F.floor(F.col("fy_age_days") / 92)).alias("stale"))
    s = dec_s(spark, d).join(age, ["cik", "as_of_date"])
    of = lambda c: F.avg(F.when(c, F.col("net_margin")))
    low = F.col("piotroski") < 4
    cells = s.groupBy("year", "stale").agg(of(low).alias("a"), of(~low).alias("b"), F.count_if(low).alias("n")).where("a is not null and b is not null")
    return cells.agg(R(F.sum((F.col("a") - F.col("b")) * F.col("n")) / F.sum("n"), 9).alias("gap"), F.count("*").alias("cells"))


@query("r22_vintage_flip_placebo", _VINT + f""", fl as (select q.*, d as draw, {_h("'0'", 'd', 'cik')} % 2 = 1 as flip from q, range(1, {DRAWS + 1}) t(d)) select draw, round(count(*) filter (where qa = 5 and qb = 5)::double / count(*) filter (where qa = 5 or qb = 5), 9) as jaccard, count(*) filter (where case when flip then qb else qa end = 5) as picks from fl group by 1""")
def r22(spark: SparkSession, d: str) -> DataFrame:
    v = dec_s(spark, d).select("cik", "year", F.col("revenue").alias("first_value"), R(F.col("revenue") * (1 + 0.04 * ((F.col("cik") * 7 + F.col("year")) % 5 - 2)), 4).alias("last_value"))
    q = P.qcut_within(P.qcut_within(v, "first_value", "year", ["cik"], 5, 1, "qa"), "last_value", "year", ["cik"], 5, 1, "qb").where("qa is not null")
    fl = q.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(DRAWS).cast("long")))).withColumn("flip", draw(F.lit(0), "draw", "cik") % 2 == 1)
    picked = F.when(F.col("flip"), F.col("qb")).otherwise(F.col("qa")) == 5
    return fl.groupBy("draw").agg(R(F.count_if(F.expr("qa = 5 and qb = 5")) / F.count_if(F.expr("qa = 5 or qb = 5")), 9).alias("jaccard"), F.count_if(picked).alias("picks"))


@query("r15_level_table", V.with_views("panel_s") + """, g as (select cik, max(qi) qi from panel_s group by 1), l as (select g.cik, k::int as k, p.gross_margin as v, g.cik % 2 = 0 as side from g, (select unnest([-8, -1]) k) join panel_s p on p.cik = g.cik and p.qi = g.qi + k), s as (select k, avg(v) filter (where side) - avg(v) filter (where not side) as gap from l group by 1) select k, round(gap, 9) as gap from s""")
def r15(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_s(spark, d)
    an = p.groupBy("cik").agg(F.max("qi").alias("qi")).withColumn("aid", F.col("cik").cast("string"))
    long = M.trajectories(an, p, ["gross_margin"]).where("k in (-8, -1)").join(an.select("aid", "cik"), "aid").withColumn("side", F.when(F.col("cik") % 2 == 0, "a").otherwise("b"))
    return B.cluster_boot_diff(long, "value", "cik", "side", "mean", DRAWS, by=["k"]).select("k", R("obs", 9).alias("gap"))


@query("j21_nearest_fiscal_year", V.with_views("share_series") + """ select cik, arg_min(fiscal_year, abs(make_date(fiscal_year, 12, 31) - date '1998-05-01') * 10000 + fiscal_year) as nearest, max(fiscal_year) as latest from shares group by 1""")
def j21(spark: SparkSession, d: str) -> DataFrame:
    gap = F.abs(F.datediff(F.make_date("fiscal_year", F.lit(12), F.lit(31)), F.to_date(F.lit("1998-05-01"))))
    return V.share_series(spark, d).groupBy("cik").agg(F.min_by("fiscal_year", F.struct(gap, "fiscal_year")).alias("nearest"), F.max("fiscal_year").alias("latest"))


@query("a24_match_rate_by_cohort", V.with_views("panel_s", "bars", "vendor_bars") + """, c as (select cik, ticker, case when cik % 7 = 0 then 'ended' else 'on' end as cohort from panel_s group by all) select coalesce(cohort, 'all') as cohort, count(*) as n, round(avg((ticker in (select ticker from vendor_bars))::int), 8) as matched from c group by rollup (cohort)""")
def a24(spark: SparkSession, d: str) -> DataFrame:
    firms = V.panel_s(spark, d).select("cik", "ticker").distinct().withColumn("cohort", F.when(F.col("cik") % 7 == 0, "ended").otherwise("on"))
    rows = A.priced_flags(V.vendor_bars(spark, d), firms)
    return rows.rollup("cohort").agg(F.count("*").alias("n"), R(share(F.col("priced")), 8).alias("matched")).withColumn("cohort", F.coalesce("cohort", F.lit("all")))


@query("a35_landing_by_outcome", V.with_views("panel_c", "listed_holders") + """, f as (select cik, ticker, max(as_of_date) last_row from panel_c group by 1, 2), h as (select ticker, list(distinct cik) cs from listed_holders group by 1), o as (select f.*, case when cs is null then 'nothing' when list_contains(cs, f.cik) then 'asked for' else 'different company' end as outcome, cik + case when cik % 20 = 18 then 1 when cik % 20 = 19 then -1 else 2 end as rc from f left join h using (ticker)), sp as (select ticker, cik as rc, min(as_of_date) fs from panel_c group by 1, 2),
 l as (select outcome, case when fs is null then 'absent' when fs > last_row then 'later' else 'earlier or overlapping' end as landing, (fs - last_row)::int as gap from o left join sp on sp.ticker = o.ticker and sp.rc = o.rc) select outcome, landing, count(*) as n, round(median(gap), 6) as median_gap, count(*) filter (where abs(gap) <= 365) as within_year from l group by 1, 2""")
def a35(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import names as N

    p = V.panel_c(spark, d)
    asked = p.groupBy("cik", "ticker").agg(F.max("as_of_date").alias("last_row")).withColumn("returned_cik", F.expr("cik + case when cik % 20 = 18 then 1 when cik % 20 = 19 then -1 else 2 end"))
    rows = N.landing(N.lookup_outcome(asked, V.listed_holders(spark, d)), p)
    return rows.groupBy("outcome", "landing").agg(F.count("*").alias("n"), R(F.median("gap_days"), 6).alias("median_gap"), F.count_if(F.abs("gap_days") <= 365).alias("within_year"))


@query("a41_priced_against_unpriced_entries", DEC_S + ", " + V.SQL["bars"] + """, x as (select dec.*, coalesce(as_of_date - date <= 14, false) as priced from dec asof left join bars on dec.ticker = bars.ticker and dec.as_of_date >= bars.date), n as (select x.*, b.net_margin as m1, (select max(year) from dec z where z.cik = x.cik) <= x.year + 1 as gone from x left join dec b on b.cik = x.cik and b.year = x.year + 1) select priced, count(*) as n, round(median(revenue), 8) as revenue, round(median(net_margin), 8) as net_margin, round(median(m1 - net_margin), 8) as change, round(avg(gone::int), 8) as gone from n group by 1""")
def a41(spark: SparkSession, d: str) -> DataFrame:
    x = A.close_at(V.bars(spark, d), dec_s(spark, d).select("cik", "year", "ticker", "as_of_date", "revenue", "net_margin"), day="as_of_date")
    x = x.withColumn("priced", F.col("px").isNotNull()).withColumn("gone", F.max("year").over(Window.partitionBy("cik")) <= F.col("year") + 1)
    later = dec_s(spark, d).select("cik", (F.col("year") - 1).alias("year"), F.col("net_margin").alias("m1"))
    n = x.join(later, ["cik", "year"], "left")
    return n.groupBy("priced").agg(F.count("*").alias("n"), R(F.median("revenue"), 8).alias("revenue"), R(F.median("net_margin"), 8).alias("net_margin"), R(F.median(F.col("m1") - F.col("net_margin")), 8).alias("change"), R(share(F.col("gone")), 8).alias("gone"))


@query("a43_sector_clock", DEC_S + ", " + V.SQL["bars"] + ", " + V.SQL["bench"] + """, m as (select a.sector, a.year, median(b.net_margin - a.net_margin) as ch from dec a join dec b on b.cik = a.cik and b.year = a.year + 1 group by 1, 2), e as (select m.*, 'S' || substr(sector, 4) as fund, make_date(year, 12, 31) as d0, make_date(year + 1, 12, 31) as d1 from m),
 p as (select e.*, f0.close f0, f1.close f1, g0.close g0, g1.close g1 from e asof left join bars f0 on e.fund = f0.ticker and e.d0 >= f0.date asof left join bars f1 on e.fund = f1.ticker and e.d1 >= f1.date asof left join bench g0 on e.d0 >= g0.date asof left join bench g1 on e.d1 >= g1.date) select count(*) as n, round(corr(ch, (f1 / f0 - 1) - (g1 / g0 - 1)), 8) as rho from p where f0 is not null and g0 is not null""")
def a43_clock(spark: SparkSession, d: str) -> DataFrame:
    """Median change of a sector-year against the return of the sector's series less the market's."""
    x = dec_s(spark, d).select("cik", "sector", "year", "net_margin")
    later = x.select("cik", (F.col("year") - 1).alias("year"), F.col("net_margin").alias("m1"))
    m = x.join(later, ["cik", "year"]).groupBy("sector", "year").agg(F.median(F.col("m1") - F.col("net_margin")).alias("ch"))
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("leg"), F.make_date(F.col("year") + k, F.lit(12), F.lit(31)).alias("day")) for k in (0, 1))))
    probes = m.select("sector", "year", F.concat(F.lit("S"), F.substring("sector", 4, 9)).alias("ticker"), ends.alias("e")).select("sector", "year", "ticker", "e.*")
    fund = A.lookup(A.positioned(V.bars(spark, d)), probes, prefix="f_")
    both = A.lookup(A.positioned(V.bench(spark, d).withColumn("ticker", F.lit("b"))), fund.withColumn("ticker", F.lit("b")), prefix="g_")
    at = lambda c, k: F.max(F.when(F.col("leg") == k, F.col(c)))
    r = both.groupBy("sector", "year").agg(((at("f_close", 1) / at("f_close", 0) - 1) - (at("g_close", 1) / at("g_close", 0) - 1)).alias("ret")).where("ret is not null")
    return m.join(r, ["sector", "year"]).agg(F.count("*").alias("n"), R(F.corr("ch", "ret"), 8).alias("rho"))


@query("e9_release_before_event", V.with_views("bars", "event_days", "panel_s") + """, pos as (select ticker, date, row_number() over (partition by ticker order by date)::int as pos from bars), rl as (select ticker, as_of_date + 40 as rel from panel_s), a as (select e.event_id, e.ticker, e.day, r.rel from event_days e asof left join rl r on e.ticker = r.ticker and e.day >= r.rel), b as (select a.*, p.pos as ep from a asof left join pos p on a.ticker = p.ticker and a.day >= p.date), c as (select b.*, q.pos as rp from b asof left join pos q on b.ticker = q.ticker and b.rel >= q.date),
 k as (select case when rel is null or day - rel > 150 then 'none' when ep - rp <= 5 then 'inside' else 'before' end as place from c) select place, count(*) as n from k group by 1""")
def e9(spark: SparkSession, d: str) -> DataFrame:
    """Where the latest release, at most 150 days back, sits: within five trading days, before, or none."""
    pos = A.positioned(V.bars(spark, d))
    releases = V.panel_s(spark, d).select("ticker", F.date_add("as_of_date", 40).alias("date"), F.lit(0.0).alias("close"))
    a = A.lookup(A.positioned(releases), V.event_days(spark, d), prefix="r_").select("event_id", "ticker", "day", F.col("r_date").alias("rel"))
    c = A.lookup(pos, A.lookup(pos, a, "day", prefix="e_"), "rel", prefix="p_")
    place = F.when(F.col("rel").isNull() | (F.datediff("day", "rel") > 150), "none").when(F.col("e_pos") - F.col("p_pos") <= 5, "inside").otherwise("before")
    return c.groupBy(place.alias("place")).agg(F.count("*").alias("n"))


@query("v16b_shapley_bootstrap", None)
def v16b(spark: SparkSession, d: str) -> DataFrame:
    """Shapley values of two blocks with whole-firm draws: the value as observed and a 95 % interval."""
    from ..operators.variance import shapley_bootstrap

    rows = shapley_bootstrap(dec_s(spark, d), "net_margin", {"a": ["operating_margin"], "b": ["gross_margin", "health_score"]}, "cik", DRAWS)
    q = lambda p: F.percentile(F.when(F.col("draw") > 0, F.col("shapley")), p)
    return rows.groupBy("block").agg(R(F.max(F.when(F.col("draw") == 0, F.col("shapley"))), 8).alias("shapley"), R(q(0.025), 8).alias("lo"), R(q(0.975), 8).alias("hi"))


def _thin_next(spark: SparkSession, d: str) -> DataFrame:
    """Firm-years with the rank of their gross margin in the year, and whether next year's net margin is thin."""
    dec = dec_s(spark, d)
    x = ranked(dec, ["year"], ["gross_margin", "cik"]).withColumn("rank", F.col("_rank") / F.col("_n"))
    later = dec.select("cik", (F.col("year") - 1).alias("year"), (F.col("net_margin") < 0.08).cast("double").alias("thin"))
    return x.join(later, ["cik", "year"])


@query("v17_clustered_logit", None)
def v17(spark: SparkSession, d: str) -> DataFrame:
    """A thin margin next year on this year's rank of the gross margin, with year effects, errors clustered by firm."""
    from ..operators.variance import cluster_logit

    years = [1996, 1997, 1998, 1999, 2000]
    rows = _thin_next(spark, d).select("thin", "cik", "rank", *((F.col("year") == y).cast("double").alias(f"y{y}") for y in years))
    out = cluster_logit(rows, "thin", ["rank", *(f"y{y}" for y in years)], "cik")
    return out.select("term", R("coefficient", 6).alias("coefficient"), R("clustered_se", 6).alias("clustered_se"))


#: Newton steps by recursion and the sandwich of two terms.
_LOGIT = DEC_S.replace("with ", "with recursive ", 1) + """, rk as (select cik, year, row_number() over (partition by year order by gross_margin nulls first, cik) / count(*) over (partition by year) as r from dec), x as (select rk.cik, rk.r, (n.net_margin < 0.08)::int::double as y from rk join dec n on n.cik = rk.cik and n.year = rk.year + 1 where n.net_margin is not null),
 nw as (select 0 as k, 0.0::double as b0, 0.0::double as b1, 1.0::double as i00, 0.0::double as i01, 1.0::double as i11 union all
  select k + 1, b0 + (h11 * s0 - h01 * s1) / det, b1 + (h00 * s1 - h01 * s0) / det, h11 / det, -h01 / det, h00 / det from (select *, h00 * h11 - h01 * h01 as det from (select any_value(k) as k, any_value(b0) as b0, any_value(b1) as b1, sum(y - p) as s0, sum((y - p) * r) as s1, sum(p * (1 - p)) as h00, sum(p * (1 - p) * r) as h01, sum(p * (1 - p) * r * r) as h11 from (select *, 1 / (1 + exp(-(b0 + b1 * r))) as p from nw, x where k < 25) having count(*) > 0))),
 en as (select * from nw where k = 25), cl as (select sum(y - p) as u0, sum((y - p) * r) as u1 from (select x.*, 1 / (1 + exp(-(b0 + b1 * r))) as p from x, en) group by cik), m as (select sum(u0 * u0) as m00, sum(u0 * u1) as m01, sum(u1 * u1) as m11 from cl)
 select 'intercept' as term, round(b0, 6) as coefficient, round(sqrt(i00 * (i00 * m00 + i01 * m01) + i01 * (i00 * m01 + i01 * m11)), 6) as clustered_se from en, m union all select 'rank', round(b1, 6), round(sqrt(i01 * (i01 * m00 + i11 * m01) + i11 * (i01 * m01 + i11 * m11)), 6) from en, m"""


@query("v17_logit_of_two_terms", _LOGIT)
def v17_two(spark: SparkSession, d: str) -> DataFrame:
    """The same without year effects."""
    from ..operators.variance import cluster_logit

    out = cluster_logit(_thin_next(spark, d).select("thin", "cik", "rank"), "thin", ["rank"], "cik")
    return out.select("term", R("coefficient", 6).alias("coefficient"), R("clustered_se", 6).alias("clustered_se"))
