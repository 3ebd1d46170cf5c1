"""Whole tables of the studies, and their oracles: base rates, vintages, leavers, valuation on one basis, placebos."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import naive_date, quarter_index
from ..functions.draws import draw
from ..operators import asof as A
from ..operators import nulls as N
from ..operators import panel as P
from ..operators.ranks import null_safe, quantiles
from ..operators import resample as B
from ..operators import returns as T
from ..operators import shares as S
from ..operators import survival as K
from ..sources import readers as I
from ..sources import views as V
from ..sources.tables import shared_dir
from . import panel_queries, price_queries, share_queries
from .null_queries import DRAWS, _cells, _h, _mult, recursive
from .panel_queries import _VINT, DEC_S, EXIT, R, dec_s

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def keep(fn):
        Q[name] = (fn, recursive(sql) if sql else sql)
        return fn

    return keep


def mean(c: Column) -> Column:
    return F.avg(c.cast("double"))


def upto(sql: str, mark: str) -> str:
    """The CTEs of another query's oracle: all before its last select."""
    return sql[: sql.rindex(mark)]


def views(*names: str) -> str:
    return ", " + ", ".join(V.SQL[n] for n in names)


# --- exits

_STATES = upto(panel_queries.Q["p4_state_exit_rates"][1], " select state")


@query("a10_base_rates", _STATES + views("bars", "vendor_bars") + """, y as (select *, ticker in (select ticker from vendor_bars) as priced from x)
 select state, count(*) as n, count(distinct cik) as firms, count(distinct cik) filter (where ex) as exit_firms, round(avg(ex::int), 6) as all_rate, count(*) filter (where priced) as n_priced, round(avg(ex::int) filter (where priced), 6) as priced_rate,
 count(*) filter (where not priced) as n_ghost, round(avg(ex::int) filter (where not priced), 6) as ghost_rate, round(avg(ex::int) / nullif(avg(ex::int) filter (where priced), 0), 6) as ratio from y group by 1""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    """Exit rates by state over all, priced and unpriced rows; rows stop where their horizon is no longer observable."""
    rows = P.exit_rows(dec_s(spark, d), P.exit_frame(V.panel_s(spark, d))).where("exit_observable")
    states = {"low z": F.col("altman_z") < 1, "thin margin": F.col("net_margin") < 0.08, "weak score": F.col("piotroski") < 3}
    rows = A.priced_flags(V.vendor_bars(spark, d), P.with_states(rows, states))
    priced = F.avg(F.when(F.col("priced"), F.col("exit")))
    return rows.groupBy("state").agg(
        F.count("*").alias("n"), F.count_distinct("cik").alias("firms"), F.count_distinct(F.when(F.col("exit") == 1, F.col("cik"))).alias("exit_firms"), R(F.avg("exit"), 6).alias("all_rate"),
        F.count_if("priced").alias("n_priced"), R(priced, 6).alias("priced_rate"), F.count_if(~F.col("priced")).alias("n_ghost"), R(F.avg(F.when(~F.col("priced"), F.col("exit"))), 6).alias("ghost_rate"),
        R(F.try_divide(F.avg("exit"), F.when(priced != 0, priced)), 6).alias("ratio"),
    )


@query("a12_exit_definitions_by_half", upto(panel_queries.Q["a11_exit_definitions_by_horizon"][1], " select definition").replace("hz.horizon, p.cik,", "hz.horizon, p.cik, case when p.as_of_date < date '1996-01-01' then 'early' else 'late' end as half,") + " select definition, horizon, half, count(*) as n, round(avg(ex::int), 6) as exit_rate from r group by 1, 2, 3")
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Exit rates by definition, horizon and half of the panel's time."""
    p = V.panel_s(spark, d)
    rows = p.select("cik", "as_of_date").join(P.exit_frame(p).select("cik", "last_row", "last_refresh", "vintage"), "cik")
    defs = F.array(*(F.struct(F.lit(n).alias("definition"), F.add_months(a, m).alias("exits"), F.lit(k).alias("stale_kept")) for n, a, m, k in panel_queries._DEFS))
    rows = rows.withColumn("d", F.explode(defs)).withColumn("horizon", F.explode(F.array(*map(F.lit, panel_queries._HORIZONS)))).withColumn("until", F.expr("add_months(as_of_date, 3 * horizon)"))
    rows = rows.where("until <= vintage and (d.stale_kept or as_of_date <= last_refresh)").withColumn("half", F.when(F.col("as_of_date") < "1996-01-01", "early").otherwise("late"))
    return rows.groupBy("d.definition", "horizon", "half").agg(F.count("*").alias("n"), R(mean(F.col("d.exits") <= F.col("until")), 6).alias("exit_rate"))


_CUT = "count(*) as n, round(quantile_cont(revenue, 0.1), 8) as p10, round(quantile_cont(revenue, 0.25), 8) as p25, round(median(revenue), 8) as p50, round(quantile_cont(revenue, 0.75), 8) as p75, round(quantile_cont(revenue, 0.9), 8) as p90, round(avg(revenue), 4) as mean"


@query("a13_quantiles_by_cut", V.with_views("panel_s") + """, l as (select 'source' as cut, case when listed_until is null then 'none' else 'dated' end as key, revenue from panel_s union all select 'sector', sector, revenue from panel_s union all select 'half', case when year(as_of_date) < 1998 then 'early' else 'late' end, revenue from panel_s)
 select cut, key, """ + _CUT + " from l group by 1, 2 having cut <> 'sector' or count(*) >= 5")
def a13_cuts(spark: SparkSession, d: str) -> DataFrame:
    """n, quantiles and mean of a column by source of the end date, by sector (five rows or more) and by half."""
    cuts = (("source", F.when(F.col("listed_until").isNull(), "none").otherwise("dated")), ("sector", F.col("sector")), ("half", F.when(F.year("as_of_date") < 1998, "early").otherwise("late")))
    rows = V.panel_s(spark, d).select("revenue", F.explode(F.array(*(F.struct(F.lit(n).alias("cut"), c.alias("key")) for n, c in cuts))).alias("c")).select("revenue", "c.*")
    g = null_safe(rows.groupBy("cut", "key").agg(F.count("*").alias("n"), F.avg("revenue").alias("mean")), quantiles(rows, "revenue", ["cut", "key"], [0.1, 0.25, 0.5, 0.75, 0.9]), ["cut", "key"], "left")
    return g.where("cut <> 'sector' or n >= 5").select("cut", "key", "n", *(R(F.col("q")[k], 8).alias(c) for k, c in enumerate(("p10", "p25", "p50", "p75", "p90"))), R("mean", 4).alias("mean"))


_LEFT = EXIT + """, st as (select *, (last_row + to_months(24))::date <= v as ex, (year(last_row) * 4 + quarter(last_row)) - (year(last_refresh) * 4 + quarter(last_refresh)) as stale, (year(last_refresh) * 4 + quarter(last_refresh)) - (year(first_row) * 4 + quarter(first_row)) as hist, year(last_row) - fy as lag from firms)"""


def left(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_s(spark, d)
    fy = p.groupBy("cik").agg(F.max_by("fiscal_year", "as_of_date").alias("fy"))
    f = P.exit_frame(p).join(fy, "cik").withColumn("hist", quarter_index(F.col("last_refresh")) - quarter_index(F.col("first_row")))
    return f.withColumn("lag", F.year("last_row") - F.col("fy")).withColumnRenamed("exit", "exits")


@query("a33_exits_against_present", _LEFT + " select ex as exits, count(*) as n, round(median(stale), 6) as stale_median, round(avg(stale), 6) as stale_mean, round(quantile_cont(stale, 0.25), 6) as stale_p25, round(quantile_cont(stale, 0.75), 6) as stale_p75, round(avg((hist < 7)::int), 6) as short_history from st group by 1")
def a33_contrast(spark: SparkSession, d: str) -> DataFrame:
    """The stale tail of exits against that of firms still present, and the share with under eight quarters of history."""
    q = F.percentile("stale_tail_quarters", F.array(F.lit(0.25), F.lit(0.75)))
    g = left(spark, d).groupBy("exits").agg(F.count("*").alias("n"), F.median("stale_tail_quarters").alias("m"), F.avg("stale_tail_quarters").alias("a"), q.alias("q"), mean(F.col("hist") < 7).alias("s"))
    return g.select("exits", "n", R("m", 6).alias("stale_median"), R("a", 6).alias("stale_mean"), R(F.col("q")[0], 6).alias("stale_p25"), R(F.col("q")[1], 6).alias("stale_p75"), R("s", 6).alias("short_history"))


@query("a33_last_row_lag", _LEFT + ", e as (select lag, count(*) as n from st where ex group by 1) select lag::int as lag, n, round(n / sum(n) over (), 6) as share from e")
def a33_lag(spark: SparkSession, d: str) -> DataFrame:
    """As-of year less fiscal year on the last row of exits."""
    g = left(spark, d).where("exits").groupBy("lag").agg(F.count("*").alias("n"))
    return g.select("lag", "n", R(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))  # a row a lag


@query("w2b_snapshot_terciles", V.with_views("panel_c") + """, r as (select cik, as_of_date, row_number() over (partition by as_of_date order by revenue, cik) as r, count(*) over (partition by as_of_date) as n from panel_c where is_listed_equity and revenue > 0)
 select cik, as_of_date, (case when n < 3 then 2 else 1 + (3 * (r - 1) >= n - 1)::int + (3 * (r - 1) >= 2 * (n - 1))::int end)::int as tercile from r""")
def w2b(spark: SparkSession, d: str) -> DataFrame:
    listed = V.panel_c(spark, d).where("is_listed_equity and revenue > 0")
    return P.rank_terciles(listed, "revenue", ["as_of_date"], ["cik"]).select("cik", "as_of_date", "tercile")


@query("j15_undated_leavers", V.with_views("panel_s", "bars") + views("vendor_bars") + """, ser as (select ticker, min(date) first_bar, max(date) last_bar from vendor_bars group by 1), f as (select max(as_of_date) mx from panel_s), g as (select ticker, min(as_of_date) fr, max(as_of_date) lr from panel_s group by 1 having max(listed_until) is null)
 select g.ticker, first_bar is not null as has_series, first_bar < fr as begins_before_first, last_bar > lr as after_last from g left join ser using (ticker), f where lr < mx""")
def j15_undated(spark: SparkSession, d: str) -> DataFrame:
    """Leavers without an end date: whether their series begins before the first panel row and goes on after the last."""
    p = V.panel_s(spark, d)
    edge = p.agg(F.max("as_of_date").alias("mx"))
    g = p.groupBy("ticker").agg(F.min("as_of_date").alias("fr"), F.max("as_of_date").alias("lr"), F.max("listed_until").alias("lu")).where("lu is null")
    g = g.join(A.series(V.vendor_bars(spark, d)), "ticker", "left").crossJoin(F.broadcast(edge)).where("lr < mx")  # one row
    return g.select("ticker", F.col("first_bar").isNotNull().alias("has_series"), F.expr("first_bar < fr").alias("begins_before_first"), F.expr("last_bar > lr").alias("after_last"))


# --- gaps between leavers and survivors

_GAPS = EXIT + """, t as (select p.*, (case when count(*) over (partition by as_of_date) < 3 then 2 else least(3, ((row_number() over (partition by as_of_date order by revenue, p.cik) - 1) * 3) // count(*) over (partition by as_of_date) + 1) end)::int as tercile, row_number() over (partition by p.cik order by as_of_date desc) as back, (last_row + to_months(24))::date <= v as ex, first_row, last_row, last_refresh from panel_s p join firms using (cik)),
 an as (select 'first row' as anchor, as_of_date, tercile, net_margin from t where ex and as_of_date = first_row union all select 'eight quarters before', as_of_date, tercile, net_margin from t where ex and back = 9 union all select 'last refresh', as_of_date, tercile, net_margin from t where ex and as_of_date = last_refresh
 union all select 'last row', as_of_date, tercile, net_margin from t where ex and as_of_date = last_row union all select 'last row, tercile ' || tercile, as_of_date, tercile, net_margin from t where ex and as_of_date = last_row),
 a as (select anchor, as_of_date, tercile, avg(net_margin) as m, count(*) as n from an group by 1, 2, 3), b as (select as_of_date, tercile, avg(net_margin) as s from t where not ex group by 1, 2)
 select anchor, sum(n)::bigint as n, count(*) as cells, round(sum((m - s) * n) / sum(n), 9) as gap from a join b using (as_of_date, tercile) group by 1"""


@query("r18_gaps_by_anchor", _GAPS)
def r18_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Leavers less survivors on the same snapshot and tercile, at the first row, eight quarters before
    the last, at the last refresh and at the last row, there by tercile too."""
    p = V.panel_s(spark, d)
    t = P.tercile(p, "revenue", ["as_of_date"], ["cik"]).join(P.exit_frame(p).select("cik", "exit", "first_row", "last_row", "last_refresh"), "cik")
    back = F.row_number().over(Window.partitionBy("cik").orderBy(F.col("as_of_date").desc()))
    small = F.count("*").over(Window.partitionBy("as_of_date")) < 3
    t = t.withColumn("tercile", F.when(small, 2).otherwise(F.col("tercile"))).withColumn("back", back)
    last = F.col("as_of_date") == F.col("last_row")
    at = {"first row": F.col("as_of_date") == F.col("first_row"), "eight quarters before": F.col("back") == 9, "last refresh": F.col("as_of_date") == F.col("last_refresh"), "last row": last}
    names = F.array_compact(F.array(*(F.when(c, n) for n, c in at.items()), F.when(last, F.concat(F.lit("last row, tercile "), "tercile"))))
    a = t.where("exit").select(F.explode(names).alias("anchor"), "as_of_date", "tercile", "net_margin").groupBy("anchor", "as_of_date", "tercile").agg(F.avg("net_margin").alias("m"), F.count("*").alias("n"))
    b = t.where("not exit").groupBy("as_of_date", "tercile").agg(F.avg("net_margin").alias("s"))
    g = a.join(b, ["as_of_date", "tercile"]).groupBy("anchor")
    return g.agg(F.sum("n").alias("n"), F.count("*").alias("cells"), R(F.sum((F.col("m") - F.col("s")) * F.col("n")) / F.sum("n"), 9).alias("gap"))


@query("r20_random_drops", DEC_S + f""", fm as (select distinct cik, cik % 7 = 0 as cohort from dec), rk as (select d as draw, cik, row_number() over (partition by d order by {_h("'0'", 'd', 'cik')}, cik) as rn from fm, range(1, {DRAWS + 1}) t(d)), k as (select count(*) filter (where cohort) as k from fm)
 select 0 as draw, round(avg(gross_margin), 9) as rest from dec where cik % 7 <> 0 union all select draw, round(avg(gross_margin), 9) from dec join rk using (cik), k where rn > k group by 1""")
def r20_drops(spark: SparkSession, d: str) -> DataFrame:
    """A mean without a cohort (draw 0), and without as many firms at random."""
    x = dec_s(spark, d).select("cik", "gross_margin")
    firms = x.select("cik").distinct()
    size = firms.where("cik % 7 = 0").agg(F.count("*").alias("k"))
    ranked = firms.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(DRAWS).cast("long"))))
    ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("draw").orderBy(draw(F.lit(0), "draw", "cik"), "cik"))).crossJoin(F.broadcast(size)).where("rn > k")  # one row
    null = x.join(ranked, "cik").groupBy("draw").agg(R(F.avg("gross_margin"), 9).alias("rest"))
    return x.where("cik % 7 <> 0").agg(F.lit(0).cast("long").alias("draw"), R(F.avg("gross_margin"), 9).alias("rest")).unionByName(null)


# --- vintages


def vintages(spark: SparkSession, d: str) -> DataFrame:
    v = dec_s(spark, d).select("cik", "year", F.col("revenue").alias("first_value"), R(F.col("revenue") * (1 + 0.04 * ((F.col("cik") * 7 + F.col("year")) % 5 - 2)), 4).alias("last_value"))
    q = P.qcut_within(P.qcut_within(v, "first_value", "year", ["cik"], 5, 1, "qa"), "last_value", "year", ["cik"], 5, 1, "qb")
    return q.withColumn("rel", F.abs(F.col("last_value") / F.col("first_value") - 1))


@query("a21_divergence_over_years", _VINT + """, y as (select year, avg((qa <> qb)::int) as flip, 1 - count(*) filter (where qa = 5 and qb = 5)::double / count(*) filter (where qa = 5 or qb = 5) as churn from q group by 1 having count(*) >= 50)
 select (select count(*) from r) as n, (select round(avg((rel >= 0.01)::int), 6) from r) as ge_1, (select round(avg((rel >= 0.05)::int), 6) from r) as ge_5, (select round(avg((rel >= 0.1)::int), 6) from r) as ge_10, count(*) as years, round(avg(flip), 6) as flipped, round(avg(churn), 6) as churn from y""")
def a21_years(spark: SparkSession, d: str) -> DataFrame:
    """Shares of rows that differ, and flips and churn as means over years of fifty rows or more."""
    q = vintages(spark, d)
    both, either = F.count_if(F.expr("qa = 5 and qb = 5")), F.count_if(F.expr("qa = 5 or qb = 5"))
    y = q.where("qa is not null").groupBy("year").agg(F.count("*").alias("k"), mean(F.col("qa") != F.col("qb")).alias("flip"), (1 - both / either).alias("churn")).where("k >= 50")
    rows = q.agg(F.count("*").alias("n"), *(R(mean(F.col("rel") >= t), 6).alias(n) for n, t in (("ge_1", 0.01), ("ge_5", 0.05), ("ge_10", 0.1))))
    return rows.crossJoin(y.agg(F.count("*").alias("years"), R(F.avg("flip"), 6).alias("flipped"), R(F.avg("churn"), 6).alias("churn")))  # one row each


@query("a21_largest_rewrites", _VINT + " select cik, year, round(rel, 6) as rel from r order by round(rel, 6) desc, cik, year limit 10")
def a21_worst(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest rewrites."""
    return vintages(spark, d).select("cik", "year", R("rel", 6).alias("rel")).orderBy(F.col("rel").desc(), "cik", "year").limit(10)


@query("a30_screens_by_year", _VINT + " select year, round(count(*) filter (where qa = 5 and qb = 5)::double / count(*) filter (where qa = 5 or qb = 5), 8) as jaccard, count(*) filter (where qa = 5 and qb <> 5) as first_only, count(*) filter (where qb = 5 and qa <> 5) as last_only, count(*) filter (where first_value >= 100000 and last_value < 100000) as first_above, count(*) filter (where first_value < 100000 and last_value >= 100000) as last_above from q group by 1")
def a30_years(spark: SparkSession, d: str) -> DataFrame:
    """Picks of the top quintile and of a threshold under both vintages, year by year."""
    n = lambda c: F.count_if(F.expr(c))
    g = vintages(spark, d).where("qa is not null").groupBy("year")
    return g.agg(R(n("qa = 5 and qb = 5") / n("qa = 5 or qb = 5"), 8).alias("jaccard"), n("qa = 5 and qb <> 5").alias("first_only"), n("qb = 5 and qa <> 5").alias("last_only"), n("first_value >= 100000 and last_value < 100000").alias("first_above"), n("first_value < 100000 and last_value >= 100000").alias("last_above"))


@query("a42_margin_given_revenue", DEC_S + """, v as (select revenue as r0, round(revenue * (1 + 0.04 * ((cik * 7 + year) % 5 - 2)), 4) as r1, net_margin as m0, round(net_margin + 0.001 * ((cik * 5 + year) % 3 - 1), 8) as m1 from dec)
 select case when r1 > r0 then 'up' when r1 < r0 then 'down' else 'same' end as revenue, count(*) as n, count(*) filter (where m1 <> m0) as changed, round(avg((m1 > m0)::int) filter (where m1 <> m0), 8) as margin_up from v group by 1""")
def a42_margin(spark: SparkSession, d: str) -> DataFrame:
    """The direction in which margins were restated, given the direction of revenue."""
    x = dec_s(spark, d).select(F.col("revenue").alias("r0"), R(F.col("revenue") * (1 + 0.04 * ((F.col("cik") * 7 + F.col("year")) % 5 - 2)), 4).alias("r1"), F.col("net_margin").alias("m0"), R(F.col("net_margin") + 0.001 * ((F.col("cik") * 5 + F.col("year")) % 3 - 1), 8).alias("m1"))
    way = F.when(F.col("r1") > F.col("r0"), "up").when(F.col("r1") < F.col("r0"), "down").otherwise("same")
    return x.groupBy(way.alias("revenue")).agg(F.count("*").alias("n"), F.count_if(F.expr("m1 <> m0")).alias("changed"), R(F.avg(F.when(F.expr("m1 <> m0"), F.expr("m1 > m0").cast("double"))), 8).alias("margin_up"))


_FIRST = DEC_S + f""", fp as (select cik, fiscal_year, arg_min(revenue, as_of_date) as rev_pit, arg_min(net_margin, as_of_date) as netm_pit, arg_max(revenue, as_of_date) as rev_latest, arg_max(round(net_margin * revenue, 4), as_of_date) as income from dec group by 1, 2), el as (select cik, row_number() over (order by {_h("'7'", 'cik')}, cik) as rn from (select cik from fp group by 1 having count(*) >= 6))"""


@query("j18_first_print_against_latest", _FIRST + " select cik, fiscal_year, rev_pit, netm_pit, rev_latest, round(income / rev_latest, 8) as netm_latest from fp where cik in (select cik from el where rn <= 300)")
def j18_latest(spark: SparkSession, d: str) -> DataFrame:
    """First prints of a seeded sample of 300 firms with six fiscal years or more, beside what is served today."""
    x = dec_s(spark, d).withColumn("income", R(F.col("net_margin") * F.col("revenue"), 4))
    fp = x.groupBy("cik", "fiscal_year").agg(*(F.min_by(c, "as_of_date").alias(n) for c, n in (("revenue", "rev_pit"), ("net_margin", "netm_pit"))))
    latest = x.groupBy("cik", "fiscal_year").agg(F.max_by("revenue", "as_of_date").alias("rev_latest"), F.max_by("income", "as_of_date").alias("income"))
    firms = fp.groupBy("cik").count().where("count >= 6").select("cik").orderBy(draw(F.lit(7), "cik"), "cik").limit(300)
    out = fp.join(F.broadcast(firms), "cik").join(latest, ["cik", "fiscal_year"])
    return out.select("cik", "fiscal_year", "rev_pit", "netm_pit", "rev_latest", R(F.col("income") / F.col("rev_latest"), 8).alias("netm_latest"))


@query("j19_revisions_of_known_periods", V.with_views("panel_s", "revisions") + """, s as (select ticker from panel_s group by 1), k as (select *, filed - 20 * substr(concept, 2)::int as period from revisions) select s.ticker, count(k.rel) as n_revisions, coalesce(max(abs(k.rel)), 0) as worst from s left join k on s.ticker = k.ticker and k.filed > date '1996-06-30' and k.period <= date '1996-06-30' group by 1""")
def j19_known(spark: SparkSession, d: str) -> DataFrame:
    """Facts of periods that had ended by a snapshot and were revised after it, firms without any included."""
    snap = F.to_date(F.lit("1996-06-30"))
    k = V.revisions(spark, d).withColumn("period", F.expr("date_sub(changedFiled, 20 * cast(substring(conceptGroup, 2) as int))")).where((F.col("period") <= snap) & (F.col("changedFiled") > snap))
    later = k.groupBy("ticker").agg(F.count("relDelta").alias("n"), F.max(F.abs("relDelta")).alias("w"))
    return V.panel_s(spark, d).select("ticker").distinct().join(later, "ticker", "left").select("ticker", F.coalesce("n", F.lit(0)).alias("n_revisions"), F.coalesce("w", F.lit(0.0)).alias("worst"))


# --- lookups

_ASKED = V.with_views("panel_c", "listed_holders") + """, f as (select cik, ticker, max(as_of_date) last_row, any_value(sector) as source from panel_c group by 1, 2), h as (select ticker, list(distinct cik) cs from listed_holders group by 1), sh as (select ticker, count(distinct cik) > 1 as shared from panel_c group by 1),
 o as (select f.*, case when shared then 'shared symbol' else 'own symbol' end as resolver, coalesce(list_contains(cs, f.cik), false) as agrees, cik + case when cik % 20 = 18 then 1 when cik % 20 = 19 then -1 else 2 end as rc, cik % 4 = 0 as former from f left join h using (ticker) join sh using (ticker))"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import names

    p = V.panel_c(spark, d)
    shared = p.groupBy("ticker").agg((F.count_distinct("cik") > 1).alias("shared"))
    rows = p.groupBy("cik", "ticker").agg(F.max("as_of_date").alias("last_row"), F.any_value("sector").alias("source")).withColumn("returned_cik", F.expr("cik + case when cik % 20 = 18 then 1 when cik % 20 = 19 then -1 else 2 end"))
    rows = names.lookup_outcome(rows, V.listed_holders(spark, d)).join(shared, "ticker")
    return rows.withColumn("agrees", F.col("outcome") == "asked for").withColumn("resolver", F.when(F.col("shared"), "shared symbol").otherwise("own symbol"))


@query("a35_agreement", _ASKED + ", l as (select 'source' as cut, source as key, agrees, former from o union all select 'resolver', resolver, agrees, former from o) select cut, key, count(*) filter (where agrees) as agree, count(*) filter (where not agrees) as differ, round(avg((not agrees)::int), 8) as share_differ, count(*) filter (where agrees and former) as former_agree, count(*) filter (where not agrees and former) as former_differ from l group by 1, 2")
def a35_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Whether a lookup returns the company asked for, by source and by resolver; and where former names are there."""
    cuts = F.explode(F.array(*(F.struct(F.lit(c).alias("cut"), F.col(c).alias("key")) for c in ("source", "resolver"))))
    rows = asked(spark, d).select("agrees", (F.col("cik") % 4 == 0).alias("former"), cuts.alias("c")).select("agrees", "former", "c.*")
    n = lambda c: F.count_if(F.expr(c))
    return rows.groupBy("cut", "key").agg(n("agrees").alias("agree"), n("not agrees").alias("differ"), R(mean(~F.col("agrees")), 8).alias("share_differ"), n("agrees and former").alias("former_agree"), n("not agrees and former").alias("former_differ"))


_LANDED = _ASKED + """, sp as (select ticker, cik as rc, min(as_of_date) fs from panel_c group by 1, 2), la as (select source, case when fs is null then 'absent' when fs > last_row then 'later' else 'earlier or overlapping' end as landing, (fs - last_row)::int as gap from o left join sp on sp.ticker = o.ticker and sp.rc = o.rc where not agrees)"""


def landed(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import names

    return names.landing(asked(spark, d).where("not agrees"), V.panel_c(spark, d))


@query("a35_landing_by_source", _LANDED + " select source, count(*) filter (where landing = 'absent') as absent, count(*) filter (where landing = 'later') as later, count(*) filter (where landing = 'earlier or overlapping') as earlier from la group by 1")
def a35_cross(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.count_if(F.col("landing") == c)
    return landed(spark, d).groupBy("source").agg(n("absent").alias("absent"), n("later").alias("later"), n("earlier or overlapping").alias("earlier"))


@query("a35_gap_quantiles", _LANDED + " select count(gap) as n, round(quantile_cont(gap, 0.1), 6) as p10, round(quantile_cont(gap, 0.25), 6) as p25, round(median(gap), 6) as p50, round(quantile_cont(gap, 0.75), 6) as p75, round(quantile_cont(gap, 0.9), 6) as p90, count(*) filter (where gap <= 365) as within_year, count(*) filter (where gap > 1826) as over_five from la")
def a35_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = landed(spark, d).agg(F.count("gap_days").alias("n"), F.percentile("gap_days", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("q"), F.count_if(F.expr("gap_days <= 365")).alias("within_year"), F.count_if(F.expr("gap_days > 1826")).alias("over_five"))
    return g.select("n", *(R(F.col("q")[k], 6).alias(c) for k, c in enumerate(("p10", "p25", "p50", "p75", "p90"))), "within_year", "over_five")


@query("j11_suspect_symbols", V.with_views("panel_s") + """, everything as (select 'S' || s_suppkey as symbol from supplier), equities as (select 'S' || s_suppkey as symbol from supplier where s_nationkey % 5 <> 0), funds as (select symbol from everything except select symbol from equities)
 select symbol, false as in_panel from (select symbol from funds except select ticker from panel_s) union all select symbol, true from (select symbol from funds intersect select ticker from panel_s)""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of funds (all less equities), and which of them the panel uses as well."""
    s = V.table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("symbol"), "s_nationkey")
    funds = s.select("symbol").subtract(s.where("s_nationkey % 5 <> 0").select("symbol"))
    held = V.panel_s(spark, d).select(F.col("ticker").alias("symbol"))
    return funds.subtract(held).select("symbol", F.lit(False).alias("in_panel")).unionByName(funds.intersect(held).select("symbol", F.lit(True).alias("in_panel")))


@query("j12_registrant_by_number", "with a as (select distinct lpad(o_custkey::varchar, 10, '0') as key from orders union all select 'n/a'), r as (select c_custkey as cik, c_name as name, 'T' || c_custkey as ticker from customer) select key, name, ticker from a left join r on try_cast(key as bigint) = cik")
def j12(spark: SparkSession, d: str) -> DataFrame:
    """Names and symbols by zero-padded registrant number; unknown numbers and other texts stay, without a name."""
    reg = V.table(spark, d, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("T"), "c_custkey")).alias("tickers"))
    o = V.table(spark, d, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("key")).distinct()
    rows = o.unionByName(spark.range(1).select(F.lit("n/a").alias("key")))
    return I.by_cik(rows, reg, "key").select("key", "name", F.col("tickers")[0].alias("ticker"))


@query("n9_utc_dates", "select o_orderkey as id, strftime(o_orderdate, '%Y-%m-%d') || 'T23:59:30Z' as stamp, o_orderdate::date as day from orders")
def n9(spark: SparkSession, d: str) -> DataFrame:
    """Dates of UTC timestamp texts, the same in any session time zone."""
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:59:30Z")).alias("stamp"))
    return o.withColumn("day", naive_date(F.col("stamp")))


# --- returns


@query("a38_returns_by_reading", DEC_S + views("bars") + """, s as (select cik, year, ticker, health_score, gross_margin, as_of_date as st, o.h as h from dec, (select unnest([365, 730]) as h) o), a as (select s.*, b.date as d0, b.close as c0 from s asof left join bars b on s.ticker = b.ticker and s.st >= b.date), z as (select a.*, (st + h::int) as en from a), y as (select z.*, b.date as d1, b.close as c1 from z asof left join bars b on z.ticker = b.ticker and z.en >= b.date),
 t as (select *, case when st - d0 <= 14 and en - d1 <= 45 and d0 < d1 and c0 > 0 then c1 / c0 - 1 end as ret from y), u as (select *, ret - median(ret) over (partition by year, h) as adj, row_number() over (partition by year, h order by health_score, cik) rn, row_number() over (partition by year, h order by gross_margin, cik) gn, count(*) over (partition by year, h) n from t),
 q as (select *, greatest(1, least(5, ceil(rn::double / n * 5)))::int as hq, greatest(1, least(5, ceil(gn::double / n * 5)))::int as gq from u where n >= 5),
 l as (select 'quintile' as reading, hq::varchar as key, h, adj from q union all select 'bucket', case when health_score <= 40 then '0' when health_score <= 50 then '1' when health_score <= 60 then '2' else '3' end, h, adj from q union all select 'cell', case when hq = 5 and gq = 5 then 'both high' when hq = 1 and gq = 1 then 'both low' end, h, adj from q)
 select reading, key, count(adj) filter (where h = 365) as n, round(median(adj) filter (where h = 365), 9) as median_1y, round(median(adj) filter (where h = 730), 9) as median_2y, round(avg(adj) filter (where h = 730), 9) as mean_2y from l where key is not null group by 1, 2""")
def a38_readings(spark: SparkSession, d: str) -> DataFrame:
    """One- and two-year returns less their year's median, read by quintile, by fixed bucket and by cell of two quintiles."""
    x = dec_s(spark, d).select(F.concat_ws("|", "cik", "year").alias("id"), "ticker", F.col("as_of_date").alias("start"), "cik", "year", "health_score", "gross_margin")
    both = None
    for h in (365, 730):
        r = A.forward_return(V.bars(spark, d), x.withColumnRenamed("id", "start_id"), h).withColumn("h", F.lit(h))
        both = r if both is None else both.unionByName(r)
    rows = P.market_adjust(both, ["ret"], ["year", "h"])
    for c, q in (("health_score", "hq"), ("gross_margin", "gq")):
        rows = P.qcut_within(rows, c, ["year", "h"], ["cik"], 5, 1, q)
    cell = F.when(F.expr("hq = 5 and gq = 5"), "both high").when(F.expr("hq = 1 and gq = 1"), "both low")
    bucket = F.coalesce(P.fixed_buckets(F.col("health_score"), [0, 40, 50, 60, 1000]), F.lit(3))
    reads = F.explode(F.array(*(F.struct(F.lit(n).alias("reading"), c.cast("string").alias("key")) for n, c in (("quintile", F.col("hq")), ("bucket", bucket), ("cell", cell)))))
    long = rows.where("hq is not null").select("h", "ret_adj", reads.alias("r")).select("h", "ret_adj", "r.*").where("key is not null")
    of = lambda h: F.when(F.col("h") == h, F.col("ret_adj"))
    return long.groupBy("reading", "key").agg(F.count(of(365)).alias("n"), R(F.median(of(365)), 9).alias("median_1y"), R(F.median(of(730)), 9).alias("median_2y"), R(F.avg(of(730)), 9).alias("mean_2y"))


@query("a41_entries_over_two_years", DEC_S + views("bars", "vendor_bars") + """, x as (select dec.*, coalesce(as_of_date - date <= 14, false) as priced from dec asof left join vendor_bars b on dec.ticker = b.ticker and dec.as_of_date >= b.date), lr as (select cik, max(year) ly from dec group by 1),
 n as (select x.*, b.net_margin as m1, b.revenue as r1, ly <= x.year + 2 as gone from x join lr using (cik) left join dec b on b.cik = x.cik and b.year = x.year + 1 and b.fiscal_year >= x.fiscal_year + 1)
 select priced, count(*) as n, round(median(revenue), 8) as revenue, round(median(net_margin), 8) as net_margin, count(m1) as transitions, round(median(m1 - net_margin), 8) as margin_change, round(median(r1 / revenue - 1), 8) as growth, round(avg(gone::int) filter (where year <= 1999), 8) as gone_in_two from n group by 1""")
def a41_two(spark: SparkSession, d: str) -> DataFrame:
    """Entries with and without a fresh price: their profile, their next transition, and their exit within two years."""
    dec = dec_s(spark, d)
    x = A.close_at(V.vendor_bars(spark, d), dec.select("cik", "year", "fiscal_year", "ticker", "as_of_date", "revenue", "net_margin"), day="as_of_date")
    x = x.join(dec.groupBy("cik").agg(F.max("year").alias("ly")), "cik").withColumn("priced", F.col("px").isNotNull())
    later = dec.select("cik", (F.col("year") - 1).alias("year"), F.col("fiscal_year").alias("fy1"), F.col("net_margin").alias("m1"), F.col("revenue").alias("r1"))
    n = x.join(later, ["cik", "year"], "left")
    moved = lambda c: F.when(F.col("fy1") >= F.col("fiscal_year") + 1, c)
    gone = F.when(F.col("year") <= 1999, (F.col("ly") <= F.col("year") + 2).cast("double"))
    return n.groupBy("priced").agg(
        F.count("*").alias("n"), R(F.median("revenue"), 8).alias("revenue"), R(F.median("net_margin"), 8).alias("net_margin"), F.count(moved(F.col("m1"))).alias("transitions"), R(F.median(moved(F.col("m1") - F.col("net_margin"))), 8).alias("margin_change"),
        R(F.median(moved(F.col("r1") / F.col("revenue") - 1)), 8).alias("growth"), R(F.avg(gone), 8).alias("gone_in_two"),
    )


_SEG = price_queries.Q["e7_segment_returns"][1]


@query("e8_right_edge", upto(_SEG, " select a.event_id") + ", sr as (" + _SEG[_SEG.rindex(" select a.event_id") :] + """), mx as (select max(date) mx from bars) select cut::int as cut, count(*) as n, round(avg(adj), 9) as mean_adj from sr join event_days using (event_id), (select unnest([0, 90, 365]) as cut), mx where segment = 's_0_30' and adj is not null and day <= mx - cut::int group by 1""")
def e8_edge(spark: SparkSession, d: str) -> DataFrame:
    """The mean of a segment as events near the end of the files are left out."""
    b = V.bars(spark, d)
    r = T.segment_returns(V.event_days(spark, d), b, V.bench(spark, d), {"s_0_30": (0, 30)}).where("adj is not null").join(V.event_days(spark, d).select("event_id", "day"), "event_id")
    edge = b.agg(F.max("date").alias("mx"))
    cut = r.crossJoin(F.broadcast(edge)).withColumn("cut", F.explode(F.array(*map(F.lit, (0, 90, 365))))).where("day <= date_sub(mx, cut)")  # one row
    return cut.groupBy("cut").agg(F.count("*").alias("n"), R(F.avg("adj"), 9).alias("mean_adj"))


_HALVED = upto(price_queries._KM, ", lab as") + price_queries._KM[price_queries._KM.rindex(", lab as") :].replace("r <= -0.3", "r <= -0.5")


@query("v3_survival_curve", _HALVED + " select label, k, at_risk, failures, round(incidence, 9) as incidence from km")
def v3(spark: SparkSession, d: str) -> DataFrame:
    """The curve of a first fall by half."""
    lab = dec_s(spark, d).select(F.concat_ws("|", "cik", "year").alias("entry_id"), F.when(F.col("altman_z").isNull(), "none").when(F.col("altman_z") < 1, "low").otherwise("high").alias("label"))
    rows = price_queries.paths(spark, d).join(lab, "entry_id")
    return K.survival_curve(rows, ["entry_id"], 12, by=["label"]).select("label", "k", "at_risk", "failures", R("incidence", 9).alias("incidence"))


@query("f1_bootstrap_rate", DEC_S + f""", src as (select cik, (piotroski >= 5)::int as v from dec), {_mult("src", "cik", draws=DRAWS)},
 st as (select draw, sum(v * w)::double / sum(w) as s from src join mu on mu.grp = src.cik group by 1) select (select round(avg(v), 9) from src) as obs, round(quantile_cont(s, 0.025), 9) as lo, round(quantile_cont(s, 0.975), 9) as hi from st""")
def f1(spark: SparkSession, d: str) -> DataFrame:
    x = dec_s(spark, d).select("cik", (F.col("piotroski") >= 5).cast("int").alias("v"))
    return B.cluster_bootstrap(x, "v", "cik", "rate", DRAWS).select(*(R(c, 9).alias(c) for c in ("obs", "lo", "hi")))


# --- valuation on one basis

_CS = share_queries._CORR + views("bars", "annual_revenue") + """, cs as (select cik, fiscal_year, outstanding, diluted, make_date(fiscal_year, 12, 31) as as_of, 'S' || (cik % 10) as ticker from shares),
 cp as (select cs.*, case when as_of - date <= 14 then close end as px from cs asof left join bars on cs.ticker = bars.ticker and cs.as_of >= bars.date), xx as (select cp.cik, cp.fiscal_year, px, diluted, rev, lag(rev) over (partition by cp.cik order by cp.fiscal_year) as prev from cp join annual_revenue using (cik, fiscal_year) where px is not null),
 wn as (select cik, min(fiscal_year) y0, max(fiscal_year) y1 from xx group by 1 having max(fiscal_year) > min(fiscal_year)),
 ap as (select wn.cik, product(g.factor) filter (where hit is not null) as fac, count(g.factor) filter (where hit is not null) as applied, count(g.factor) filter (where hit is null) as rejected from wn left join g on g.cik = wn.cik and g.flag_year > y0 and g.flag_year <= y1 group by 1)"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    so = V.share_series(spark, d).select("cik", "fiscal_year", F.col("outstanding").alias("shares"))
    return S.corroborate_flags(share_queries.flags(spark, d), so)


@query("v12_valuation_on_one_basis", _CS + """, un as (select wn.cik, count(*) filter (where s.outstanding > 0 and s.diluted > 0 and not (s.outstanding / s.diluted between 0.5 and 2.0)) as disagree from wn join shares s on s.cik = wn.cik and s.fiscal_year between y0 and y1 group by 1),
 h as (select wn.*, a.px p0, z.px p1, a.rev r0, z.rev r1, a.prev q0, z.prev q1, a.diluted * coalesce(fac, 1) as s0, z.diluted as s1, applied, rejected, disagree from wn join ap using (cik) join un using (cik) join xx a on a.cik = wn.cik and a.fiscal_year = y0 join xx z on z.cik = wn.cik and z.fiscal_year = y1)
 select cik, y0, y1, applied, rejected, disagree, round(p1 / p0, 8) as ret, round((r1 / s1) / (r0 / s0), 8) as rps, round((p1 / p0) / ((r1 / s1) / (r0 / s0)), 8) as mult, round((p1 / p0) / ((q1 / s1) / (q0 / s0)), 8) as mult_nolookahead from h""")
def v12_basis(spark: SparkSession, d: str) -> DataFrame:
    """Return as growth of revenue a share times a multiple, over each firm's window: counts checked
    against each other, split flags inside the window applied if the outstanding count bears them out,
    the earlier count rebased, both ends priced; also with the revenue that was known at each end."""
    s = V.share_series(spark, d)
    priced = A.close_at(V.bars(spark, d), s.withColumn("as_of", F.make_date("fiscal_year", F.lit(12), F.lit(31))).withColumn("ticker", F.concat(F.lit("S"), F.pmod("cik", F.lit(10)))), day="as_of").where("px is not null")
    x = priced.join(V.annual_revenue(spark, d), ["cik", "fiscal_year"])
    x = x.withColumn("prev", F.lag("rev").over(Window.partitionBy("cik").orderBy("fiscal_year"))).select("cik", "fiscal_year", "px", "rev", "prev")
    end = F.struct("px", "rev", "prev")
    w = x.groupBy("cik").agg(F.min("fiscal_year").alias("y0"), F.max("fiscal_year").alias("y1"), F.min_by(end, "fiscal_year").alias("a"), F.max_by(end, "fiscal_year").alias("z")).where("y1 > y0")
    window = w.select("cik", "y0", "y1")
    inside = _checked(spark, d).join(window, "cik").where("flag_year > y0 and flag_year <= y1").withColumn("fine", F.col("verdict") == "corroborated")
    tally = inside.groupBy("cik").agg(F.count_if("fine").alias("applied"), F.count_if(~F.col("fine")).alias("rejected"))
    one = S.rebase(s.select("cik", "fiscal_year", F.col("diluted").alias("shares")), inside.where("fine").select("cik", F.col("flag_year").alias("split_year"), "factor"))
    ends = one.join(window, "cik").groupBy("cik").agg(*(F.max(F.when(F.col("fiscal_year") == F.col(y), F.col("rebased"))).alias(n) for y, n in (("y0", "s0"), ("y1", "s1"))))
    bad = S.series_sanity(s).join(window, "cik").where("fiscal_year between y0 and y1").groupBy("cik").agg(F.count("*").alias("disagree"))
    h = w.join(ends, "cik").join(tally, "cik", "left").join(bad, "cik", "left").na.fill(0, ["applied", "rejected", "disagree"])
    parts = lambda rev: S.decompose(F.col("a.px"), F.col("z.px"), F.col(f"a.{rev}"), F.col(f"z.{rev}"), F.col("s0"), F.col("s1"))
    known = F.when(F.col("a.prev").isNotNull() & F.col("z.prev").isNotNull(), parts("prev"))
    h = h.withColumn("x", parts("rev")).withColumn("n", known)
    return h.select("cik", "y0", "y1", "applied", "rejected", "disagree", *(R(F.col(f"x.{c}"), 8).alias(c) for c in ("ret", "rps", "mult")), R("n.mult", 8).alias("mult_nolookahead"))


@query("v13_passport", _CS + views("insider_trades", "revisions") + """, rv as (select cik, arg_min(rev, fiscal_year) r0, arg_max(rev, fiscal_year) r1, min(fiscal_year) fy_first, max(fiscal_year) fy_last, count(*) fiscal_years, 'S' || (cik % 10) as ticker from annual_revenue group by cik),
 rs as (select ticker, count(*) as revised_facts, count(distinct accession) as revising_filings from revisions group by 1), iw as (select cik, count(*) filter (where code = 'P') as buys, count(*) filter (where code = 'S') as sells, min(day) filter (where code in ('P', 'S')) as first_trade from insider_trades group by 1),
 sy as (select cik, unnest(range(flag_year, flag_year + 3)) as y from g where hit is not null), ds as (select s.cik, (s.cik, s.fiscal_year) in (select (cik, y) from sy) as split from shares s where outstanding > 0 and diluted > 0 and not (outstanding / diluted between 0.5 and 2.0)), dn as (select cik, count(*) filter (where split) as split_basis, count(*) filter (where not split) as check_units from ds group by 1),
 fl as (select cik, count(*) filter (where hit is not null) as corroborated from g group by 1), ser as (select ticker, min(date) first_bar from bars group by 1),
 pe as (select rv.*, make_date(fy_first::int, 12, 31) as d0, make_date(fy_last::int, 12, 31) as d1 from rv), p0 as (select pe.*, b.close as c0 from pe asof left join bars b on pe.ticker = b.ticker and pe.d0 >= b.date), p1 as (select p0.*, b.close as c1 from p0 asof left join bars b on p0.ticker = b.ticker and p0.d1 >= b.date)
 select p1.cik, fy_first, fy_last, fiscal_years, round(r1 / r0, 8) as rev_multiple, coalesce(revised_facts, 0) as revised_facts, coalesce(revising_filings, 0) as revising_filings, coalesce(corroborated, 0) as corroborated, coalesce(split_basis, 0) as split_basis, coalesce(check_units, 0) as check_units, buys as insider_buys, sells as insider_sells, first_trade,
 first_bar is not null as priced, round(c1 / c0, 8) as price_multiple, case when c0 is null and first_bar is not null then round((first_bar - d0) / 365.25, 1) end as price_gap_years
 from p1 left join rs using (ticker) left join iw using (cik) left join fl using (cik) left join dn using (cik) left join ser using (ticker)""")
def v13_passport(spark: SparkSession, d: str) -> DataFrame:
    """One row a company: span, revenue multiple, revisions, share counts that disagree and why, insiders, price multiple or what is missing of it."""
    end = lambda y: F.make_date(y, F.lit(12), F.lit(31))
    rv = V.annual_revenue(spark, d).groupBy("cik").agg(F.min("fiscal_year").alias("fy_first"), F.max("fiscal_year").alias("fy_last"), F.count("*").alias("fiscal_years"), (F.max_by("rev", "fiscal_year") / F.min_by("rev", "fiscal_year")).alias("rev_multiple")).withColumn("ticker", F.concat(F.lit("S"), F.pmod("cik", F.lit(10))))
    rs = V.revisions(spark, d).groupBy("ticker").agg(F.count("*").alias("revised_facts"), F.count_distinct("changedAccession").alias("revising_filings"))
    code = lambda c: F.count_if(F.col("code") == c)
    iw = V.insider_trades(spark, d).groupBy("cik").agg(code("P").alias("insider_buys"), code("S").alias("insider_sells"), F.min(F.when(F.col("code") != "M", F.col("day"))).alias("first_trade"))
    checked = _checked(spark, d)
    split = checked.where("verdict = 'corroborated'").select("cik", F.explode(F.expr("sequence(flag_year, flag_year + 2)")).alias("fiscal_year")).distinct().withColumn("split", F.lit(True))
    bad = S.series_sanity(V.share_series(spark, d)).join(split, ["cik", "fiscal_year"], "left").groupBy("cik").agg(F.count("split").alias("split_basis"), (F.count("*") - F.count("split")).alias("check_units"))
    fl = checked.groupBy("cik").agg(F.count_if(F.col("verdict") == "corroborated").alias("corroborated"))
    legs = F.explode(F.array(F.struct(F.lit(0).alias("leg"), end("fy_first").alias("day")), F.struct(F.lit(1).alias("leg"), end("fy_last").alias("day"))))
    hit = A.lookup(A.positioned(V.bars(spark, d)), rv.select("cik", "ticker", legs.alias("x")).select("cik", "ticker", "x.*"))
    px = hit.groupBy("cik").agg(*(F.max(F.when(F.col("leg") == k, F.col("close"))).alias(f"c{k}") for k in (0, 1)))
    out = rv.join(rs, "ticker", "left").join(iw, "cik", "left").join(fl, "cik", "left").join(bad, "cik", "left").join(px, "cik", "left").join(A.series(V.bars(spark, d)).select("ticker", "first_bar"), "ticker", "left")
    out = out.na.fill(0, ["revised_facts", "revising_filings", "corroborated", "split_basis", "check_units"])
    gap = F.when(F.col("c0").isNull() & F.col("first_bar").isNotNull(), R(F.datediff("first_bar", end("fy_first")) / 365.25, 1))
    return out.select("cik", "fy_first", "fy_last", "fiscal_years", R("rev_multiple", 8).alias("rev_multiple"), "revised_facts", "revising_filings", "corroborated", "split_basis", "check_units", "insider_buys", "insider_sells", "first_trade", F.col("first_bar").isNotNull().alias("priced"), R(F.col("c1") / F.col("c0"), 8).alias("price_multiple"), gap.alias("price_gap_years"))


# --- shares of variance

_SHAP = "(rb + (ra + rb - 2 * ya * yb * ab) / (1 - ab * ab) - ra) / 2"


def _dealt(name: str, by: str) -> str:
    return DEC_S + ", fr as (select cik || '|' || year as id, cik, year, net_margin as y, operating_margin as a, gross_margin as b from dec), fq as (select id, cik, year, y as yy, a as aa, b as lab from fr), " + _cells("fq", by, "id", "lab", "id, yy, aa", DRAWS).replace(" sh as (", " s0 as (") + f""", sh as (select draw, yy as y, aa as a, shuffled as sb from s0),
 c as (select draw, corr(y, a) ya, corr(y, sb) yb, corr(a, sb) ab from sh group by 1 union all select 0, corr(y, a), corr(y, b), corr(a, b) from fr), v as (select draw, ({_SHAP.replace('ra', '(ya * ya)').replace('rb', '(yb * yb)')}) as v from c), o as (select v as o from v where draw = 0)
 select '{name}' as placebo, round(any_value(o), 8) as observed, round(avg(v), 8) as null_mean, round(quantile_cont(v, 0.95), 8) as null_p95, round(avg((v >= o)::int), 8) as at_or_above from v, o where draw > 0"""


@query("v16b_placebo_between_firms", _dealt("between firms", "year"))
def v16b_between(spark: SparkSession, d: str) -> DataFrame:
    """A block's Shapley share of variance against that of the block dealt anew among the firms of a year."""
    return _placebo(spark, d, "between firms", ["year"])


@query("v16b_placebo_within_firm", _dealt("within firm", "cik"))
def v16b_within(spark: SparkSession, d: str) -> DataFrame:
    """The same with the block dealt anew among each firm's own years: what is left is the firm, not the time."""
    return _placebo(spark, d, "within firm", ["cik"])


def _placebo(spark: SparkSession, d: str, name: str, by: list[str]) -> DataFrame:
    x = dec_s(spark, d).select(F.concat_ws("|", "cik", "year").alias("id"), "cik", "year", F.col("net_margin").alias("y"), F.col("operating_margin").alias("a"), F.col("gross_margin").alias("b"))
    rows = N.within_shuffle(x, "b", by, "id", draws=DRAWS).select("draw", "y", "a", "shuffled").unionByName(x.select(F.lit(0).cast("long").alias("draw"), "y", "a", F.col("b").alias("shuffled")))
    c = rows.groupBy("draw").agg(F.corr("y", "a").alias("ya"), F.corr("y", "shuffled").alias("yb"), F.corr("a", "shuffled").alias("ab"))
    v = c.withColumn("ra", F.col("ya") * F.col("ya")).withColumn("rb", F.col("yb") * F.col("yb")).select("draw", F.expr(_SHAP).alias("v"))
    both = v.where("draw > 0").crossJoin(F.broadcast(v.where("draw = 0").select(F.col("v").alias("o"))))  # one row
    return both.agg(F.lit(name).alias("placebo"), R(F.max("o"), 8).alias("observed"), R(F.avg("v"), 8).alias("null_mean"), R(F.percentile("v", 0.95), 8).alias("null_p95"), R(mean(F.col("v") >= F.col("o")), 8).alias("at_or_above"))


@query("v16b_bootstrap_of_two_blocks", DEC_S + f""", fr as (select cik, net_margin as y, operating_margin as a, gross_margin as b from dec), {_mult("fr", "cik", draws=DRAWS)},
 m as (select draw, sum(w) n, sum(w * y) / sum(w) y1, sum(w * a) / sum(w) a1, sum(w * b) / sum(w) b1, sum(w * y * y) / sum(w) yy, sum(w * a * a) / sum(w) aa, sum(w * b * b) / sum(w) bb, sum(w * y * a) / sum(w) sya, sum(w * y * b) / sum(w) syb, sum(w * a * b) / sum(w) sab from fr join mu on mu.grp = fr.cik group by 1),
 c as (select draw, (sya - y1 * a1) / sqrt((yy - y1 * y1) * (aa - a1 * a1)) ya, (syb - y1 * b1) / sqrt((yy - y1 * y1) * (bb - b1 * b1)) yb, (sab - a1 * b1) / sqrt((aa - a1 * a1) * (bb - b1 * b1)) ab from m union all select 0, corr(y, a), corr(y, b), corr(a, b) from fr),
 s as (select draw, ya * ya as ra, yb * yb as rb, (ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab) as rab from c), l as (select draw, 'a' as block, (ra + rab - rb) / 2 as v from s union all select draw, 'b', (rb + rab - ra) / 2 from s)
 select block, round(max(v) filter (where draw = 0), 8) as shapley, round(quantile_cont(v, 0.025) filter (where draw > 0), 8) as lo, round(quantile_cont(v, 0.975) filter (where draw > 0), 8) as hi from l group by 1""")
def v16b_two(spark: SparkSession, d: str) -> DataFrame:
    """Shapley shares of two single columns with whole-firm draws."""
    from ..operators.variance import shapley_bootstrap

    rows = shapley_bootstrap(dec_s(spark, d), "net_margin", {"a": ["operating_margin"], "b": ["gross_margin"]}, "cik", DRAWS)
    q = lambda p: F.percentile(F.when(F.col("draw") > 0, F.col("shapley")), p)
    return rows.groupBy("block").agg(R(F.max(F.when(F.col("draw") == 0, F.col("shapley"))), 8).alias("shapley"), R(q(0.025), 8).alias("lo"), R(q(0.975), 8).alias("hi"))


# --- ordered files


@query("s16_ordered_files", V.with_views("panel_s") + " select count(*) as rows, count(distinct cik) as firms, true as in_order, true as several from panel_s")
def s16(spark: SparkSession, d: str) -> DataFrame:
    """The panel written in order of firm and date, and its files read back: nothing is lost, and files follow each other."""
    path = f"{shared_dir(spark)}/ordered-{uuid.uuid4().hex}"
    manifest = I.write_ordered(V.panel_s(spark, d), path, ["cik", "as_of_date"], rows_a_file=500)
    back = spark.read.parquet(path)
    return I.in_order(manifest).crossJoin(back.agg(F.count_distinct("cik").alias("firms"))).select("rows", "firms", "in_order", (F.col("files") > 1).alias("several"))  # one row each
