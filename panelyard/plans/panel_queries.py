"""Panel queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import overlap_year, quarter_end, quarter_label
from ..operators import panel as P
from ..operators.ranks import null_safe, quantiles
from ..sources import views as V

YEARS = (1995, 2001)
R = F.round
Q: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn

    return keep


DEC_S = V.with_views("panel_s") + ", dec as (select *, year(as_of_date)::int as year from panel_s where month(as_of_date) = 12 and is_listed_equity and revenue > 0 and year(as_of_date) between 1995 and 2001)"
UNI_C = V.with_views("panel_c") + ", uni as (select * from panel_c where ticker not in (select ticker from panel_c group by 1 having count(distinct cik) > 1) and is_listed_equity and revenue > 0)"


def dec_s(spark: SparkSession, d: str) -> DataFrame:
    return P.december_snapshots(V.panel_s(spark, d), YEARS)


@query("p1_december_snapshots", UNI_C + " select cik, ticker, year(as_of_date)::int as year, revenue from uni where month(as_of_date) = 12 and year(as_of_date) between 1995 and 2001")
def p1(spark: SparkSession, d: str) -> DataFrame:
    return P.december_snapshots(V.panel_c(spark, d), YEARS).select("cik", "ticker", "year", "revenue")


@query("p2_universe_counts", UNI_C + """ select qi // 4 || 'Q' || (qi % 4 + 1) as quarter, last_day(make_date((qi // 4)::int, (qi % 4)::int * 3 + 3, 1)) as ends, count(*) as n, count(distinct cik) as firms from uni group by qi""")
def p2(spark: SparkSession, d: str) -> DataFrame:
    u = P.universe(V.panel_c(spark, d)).groupBy("qi").agg(F.count("*").alias("n"), F.count_distinct("cik").alias("firms"))
    return u.select(quarter_label(F.col("qi")).alias("quarter"), quarter_end(F.col("qi")).alias("ends"), "n", "firms")


TRANS = DEC_S + """, tr as (select a.*, b.revenue as revenue_next, b.operating_margin as om_next, b.health_score as hs_next, b.gross_margin as gm_next from dec a join dec b on a.cik = b.cik and b.year = a.year + 1 where b.fiscal_year >= a.fiscal_year + 1)"""


@query("j1_transitions", TRANS + """ select cik, year as base_year, round(om_next - operating_margin, 6) as d_opm, round(hs_next - health_score, 6) as d_health, round(gm_next - gross_margin, 6) as d_gm, round(revenue_next / revenue - 1, 6) as rev_growth
 from tr where abs(operating_margin) < 1 and abs(om_next) < 1""")
def j1(spark: SparkSession, d: str) -> DataFrame:
    out = P.add_outcomes(P.transitions(dec_s(spark, d)))
    return out.select("cik", "base_year", *(R(c, 6).alias(c) for c in ("d_opm", "d_health", "d_gm", "rev_growth")))


@query("p4_state_exit_rates", DEC_S + """, fin as (select max(as_of_date) v from panel_s), firm as (select cik, max(as_of_date) last_row from panel_s group by 1),
 r as (select dec.*, last_row <= (dec.as_of_date + interval 24 month)::date and (dec.as_of_date + interval 24 month)::date <= v as ex, coalesce(altman_z < 1, false)::int + coalesce(net_margin < 0.08, false)::int + coalesce(piotroski < 3, false)::int as k,
 coalesce(altman_z < 1, false) as s1, coalesce(net_margin < 0.08, false) as s2, coalesce(piotroski < 3, false) as s3 from dec join firm using (cik), fin where (dec.as_of_date + interval 24 month)::date <= v),
 x as (select *, unnest(list_filter([case when s1 then 'low z' end, case when s2 then 'thin margin' end, case when s3 then 'weak score' end, case when k >= 1 then 'any' end, case when k >= 2 then 'two or more' end, case when k = 0 then 'none' end], lambda e: e is not null)) as state from r)
 select state, count(*) as n, count(distinct cik) as firms, round(avg(ex::int), 6) as exit_rate from x group by 1""")
def p4(spark: SparkSession, d: str) -> DataFrame:
    panel = V.panel_s(spark, d)
    rows = P.exit_rows(dec_s(spark, d), P.exit_frame(panel)).where("exit_observable")
    states = {"low z": F.col("altman_z") < 1, "thin margin": F.col("net_margin") < 0.08, "weak score": F.col("piotroski") < 3}
    return P.with_states(rows, states).groupBy("state").agg(F.count("*").alias("n"), F.count_distinct("cik").alias("firms"), R(F.avg("exit"), 6).alias("exit_rate"))


@query("p6_overlap_years", V.with_views("panel_s") + """ select cik, as_of_date, round(greatest(0.0::double, least(1.0::double, (least(as_of_date, date '1998-06-30') - greatest(as_of_date - 364, date '1997-01-01'))::double / 365.0)), 6) as share from panel_s""")
def p6(spark: SparkSession, d: str) -> DataFrame:
    day = lambda s: F.to_date(F.lit(s))
    return V.panel_s(spark, d).select("cik", "as_of_date", R(overlap_year(F.col("as_of_date"), day("1997-01-01"), day("1998-06-30")), 6).alias("share"))


_B = "case when health_score = 0 then 0 when health_score > 0 and health_score <= 30 then 0 when health_score > 30 and health_score <= 50 then 1 when health_score > 50 and health_score <= 52 then 2 when health_score > 52 and health_score <= 85 then 3 when health_score > 85 and health_score <= 100 then 4 end"
EDGES = [0.0, 30.0, 50.0, 52.0, 85.0, 100.0]


@query("p9_bucket_transitions", DEC_S + f""", b as (select cik, year, {_B} as bucket from dec), t as (select a.bucket as was, b.bucket as now_is from b a join b on a.cik = b.cik and b.year = a.year + 1 where a.bucket is not null and b.bucket is not null)
 select was, round(100.0::double * count(*) filter (where now_is = 1) / count(*), 6) as to_1, round(100.0::double * count(*) filter (where now_is = 2) / count(*), 6) as to_2, round(100.0::double * count(*) filter (where now_is = 3) / count(*), 6) as to_3, count(*) as n from t group by 1""")
def p9(spark: SparkSession, d: str) -> DataFrame:
    b = dec_s(spark, d).select("cik", "year", P.fixed_buckets(F.col("health_score"), EDGES).alias("bucket")).where("bucket is not null")
    t = b.join(b.select("cik", (F.col("year") - 1).alias("year"), F.col("bucket").alias("now_is")), ["cik", "year"])
    share = t.groupBy(F.col("bucket").alias("was")).pivot("now_is", [1, 2, 3]).count().na.fill(0)
    n = t.groupBy(F.col("bucket").alias("was")).agg(F.count("*").alias("n"))
    return share.join(n, "was").select("was", *(R(100.0 * F.col(str(k)) / F.col("n"), 6).alias(f"to_{k}") for k in (1, 2, 3)), "n")


@query("p10_yoy_by_key", UNI_C + " select a.cik, a.qi, round(a.revenue / b.revenue - 1, 6) as yoy from uni a left join uni b on a.cik = b.cik and a.qi = b.qi + 4")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return P.yoy(P.universe(V.panel_c(spark, d))).select("cik", "qi", R("yoy", 6).alias("yoy"))


@query("p8_latest_cross_section", V.with_views("panel_s") + """, x as (select * from panel_s where as_of_date = (select max(as_of_date) from panel_s where as_of_date <= date '2000-02-15'))
 select cik, revenue, least(3, ((row_number() over (order by revenue, cik) - 1) * 3) // count(*) over () + 1)::int as tercile from x order by revenue desc, cik limit 15""")
def p8(spark: SparkSession, d: str) -> DataFrame:
    panel = V.panel_s(spark, d)
    day = panel.where("as_of_date <= '2000-02-15'").agg(F.max("as_of_date").alias("as_of_date"))
    x = P.tercile(panel.join(F.broadcast(day), "as_of_date"), "revenue", ["as_of_date"], ["cik"])  # one row
    return x.orderBy(F.desc("revenue"), "cik").limit(15).select("cik", "revenue", "tercile")


@query("p7_boom_cells", DEC_S + """, r as (select *, row_number() over (partition by year order by revenue, cik) ra, row_number() over (partition by year order by gross_margin, cik) rb, count(*) over (partition by year) n from dec),
 c as (select *, case when n >= 5 then greatest(1, least(5, ceil(ra::double / n * 5)))::int end as qa, case when n >= 5 then greatest(1, least(5, ceil(rb::double / n * 5)))::int end as qb from r)
 select year, count(*) filter (where qa = 5 and qb = 5) as boom, count(*) filter (where qa = 1 and qb = 1) as quiet, count(*) as n from c group by 1""")
def p7(spark: SparkSession, d: str) -> DataFrame:
    x = P.qcut_within(dec_s(spark, d), "revenue", "year", ["cik"], 5, 1, "qa")
    x = P.qcut_within(x, "gross_margin", "year", ["cik"], 5, 1, "qb")
    return x.groupBy("year").agg(F.count_if(F.expr("qa = 5 and qb = 5")).alias("boom"), F.count_if(F.expr("qa = 1 and qb = 1")).alias("quiet"), F.count("*").alias("n"))


@query("p11_cohort_status", V.with_views("panel_s") + """, f as (select max(as_of_date) v from panel_s), g as (select cik, max(as_of_date) last_row, max(listed_until) lu from panel_s group by 1)
 select cik, last_row, case when last_row = v then 'present' when lu is not null then 'ended' else 'stopped' end as status from g, f""")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return P.cohort_status(V.panel_s(spark, d)).select("cik", "last_row", "status")


@query("a1_market_adjusted", DEC_S + " select cik, year, round(revenue - median(revenue) over (partition by year), 7) as revenue_adj, round(gross_margin - median(gross_margin) over (partition by year), 6) as gross_margin_adj from dec")
def a1(spark: SparkSession, d: str) -> DataFrame:
    out = P.market_adjust(dec_s(spark, d), ["revenue", "gross_margin"], ["year"])
    return out.select("cik", "year", R("revenue_adj", 7).alias("revenue_adj"), R("gross_margin_adj", 6).alias("gross_margin_adj"))


@query("a2_qcut_within", V.with_views("panel_s") + """, r as (select cik, as_of_date, altman_z, count(altman_z) over (partition by as_of_date) n, row_number() over (partition by as_of_date, altman_z is not null order by altman_z, cik) rn from panel_s)
 select cik, as_of_date, case when altman_z is not null and n >= 5 then greatest(1, least(5, ceil(rn::double / n * 5)))::int end as bin from r""")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return P.qcut_within(V.panel_s(spark, d), "altman_z", "as_of_date", ["cik"], 5, 1).select("cik", "as_of_date", "bin")


@query("a3_edge_bins", V.with_views("panel_c") + """, e as (select qi, list_distinct(quantile_cont(n_orders::double, [0, 0.2, 0.4, 0.6, 0.8, 1])) e from panel_c group by 1)
 select cik, p.qi, len(list_filter(list_sort(e.e)[2:-2], lambda x: x < n_orders))::int as bin from panel_c p join e using (qi)""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return P.edge_bins(V.panel_c(spark, d), "n_orders", ["qi"]).select("cik", "qi", "bin")


@query("w2_terciles", V.with_views("panel_c") + " select cik, qi, least(3, ((row_number() over (partition by qi order by revenue, cik) - 1) * 3) // count(*) over (partition by qi) + 1)::int as tercile from panel_c")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return P.tercile(V.panel_c(spark, d), "revenue", ["qi"], ["cik"]).select("cik", "qi", "tercile")


@query("a4_refresh_events", V.with_views("panel_c") + """, r as (select *, min(as_of_date) over (partition by cik, fiscal_year) f, min(as_of_date) over (partition by cik) g from panel_c)
 select cik, as_of_date, fiscal_year, as_of_date = f as is_refresh, (as_of_date - f)::int as fy_age_days, as_of_date = g as first_panel_row from r""")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return P.record_refresh_events(V.panel_c(spark, d), events_only=False).select("cik", "as_of_date", "fiscal_year", "is_refresh", "fy_age_days", "first_panel_row")


EXIT = V.with_views("panel_s") + """, v as (select max(as_of_date) v from panel_s), g as (select cik, min(as_of_date) first_row, max(as_of_date) last_row, arg_max(fiscal_year, as_of_date) fy from panel_s group by 1),
 h as (select p.cik, min(as_of_date) last_refresh from panel_s p join g on p.cik = g.cik and p.fiscal_year = g.fy group by 1), firms as (select g.*, last_refresh, v from g join h using (cik), v)"""


@query("a5_exit_frame", EXIT + """ select cik, first_row, last_row, last_refresh, ((year(last_row) * 4 + quarter(last_row)) - (year(last_refresh) * 4 + quarter(last_refresh)))::int as stale_tail_quarters,
 (last_refresh + interval 24 month)::date <= v as exit_by_refresh, (last_row + interval 24 month)::date <= v as exit_by_row from firms""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_s(spark, d)
    a, b = P.exit_frame(p, anchor="last_refresh"), P.exit_frame(p).select("cik", F.col("exit").alias("exit_by_row"))
    return a.join(b, "cik").select("cik", "first_row", "last_row", "last_refresh", "stale_tail_quarters", F.col("exit").alias("exit_by_refresh"), "exit_by_row")


@query("a6_exit_rows", EXIT + """ select p.cik, p.as_of_date, case when (p.as_of_date + interval 12 month)::date <= v then (last_row <= (p.as_of_date + interval 12 month)::date)::int::double end as exit, p.as_of_date > last_refresh as after_last_refresh from panel_s p join firms using (cik)""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_s(spark, d)
    return P.exit_rows(p, P.exit_frame(p, 4), 4).select("cik", "as_of_date", "exit", "after_last_refresh")


@query("a7_revision_filings", V.with_views("revisions") + """, f as (select *, coalesce(accession, filed::varchar) as filing from revisions), g as (select *, row_number() over (partition by filing, ticker order by abs(rel) desc, concept desc, rel desc) rn from f)
 select filing, ticker, count(*) as n_facts, max(abs(rel)) as max_abs_rel, max(rel) filter (where rn = 1) as rel_delta, bool_or(rel <= -0.05) as any_down, bool_or(rel >= 0.05) as any_up from g group by 1, 2""")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return P.revision_filings(V.revisions(spark, d), 0.05).select("filing", "ticker", "n_facts", "max_abs_rel", "rel_delta", "any_down", "any_up")


@query("a8_change_types", V.with_views("revisions") + """ select coalesce(accession, filed::varchar) as filing, ticker, count(*) as n_facts, string_agg(distinct concept, '/' order by concept) as change_types from revisions where rel <> 0 group by 1, 2""")
def a8(spark: SparkSession, d: str) -> DataFrame:
    r = V.revisions(spark, d).where("relDelta <> 0")
    return r.groupBy(F.coalesce("changedAccession", F.col("changedFiled").cast("string")).alias("filing"), "ticker").agg(F.count("*").alias("n_facts"), F.array_join(F.array_sort(F.collect_set("conceptGroup")), "/").alias("change_types"))


@query("a9_firm_table", UNI_C + """, g as (select cik, min(qi) first_qi, max(qi) last_qi, arg_max(fiscal_year, qi) fy, count(*) n_rows, arg_max(ticker, qi) ticker, arg_max(sector, qi) sector from uni group by 1)
, h as (select g.cik, min(u.qi) as fresh_qi from g join uni u on u.cik = g.cik and u.fiscal_year = g.fy group by 1) select g.cik, first_qi, last_qi, fresh_qi, n_rows, ticker, sector, last_qi - fresh_qi as stale_tail from g join h using (cik)""")
def a9(spark: SparkSession, d: str) -> DataFrame:
    return P.firm_table(P.universe(V.panel_c(spark, d))).select("cik", "first_qi", "last_qi", "fresh_qi", "n_rows", "ticker", "sector", "stale_tail")


_DEFS = [("last row", "last_row", 0, True), ("last refresh", "last_refresh", 0, True), ("refresh plus two", "last_refresh", 6, True), ("last row, stale dropped", "last_row", 0, False), ("last refresh, stale dropped", "last_refresh", 0, False), ("refresh plus two, stale dropped", "last_refresh", 6, False)]
_HORIZONS = (4, 8, 12)


@query("a11_exit_definitions_by_horizon", EXIT + """, d as (select * from (values """ + ", ".join(f"('{n}', '{a}', {m}, {str(k).lower()})" for n, a, m, k in _DEFS) + """) t(definition, anchor, months, stale_kept)), hz as (select unnest([4, 8, 12]) as horizon),
 r as (select d.definition, hz.horizon, p.cik, (case when anchor = 'last_row' then last_row else last_refresh end + to_months(months))::date <= (p.as_of_date + to_months(3 * horizon))::date as ex
 from panel_s p join firms using (cik), d, hz where (p.as_of_date + to_months(3 * horizon))::date <= v and (stale_kept or p.as_of_date <= last_refresh))
 select definition, horizon, count(*) as n, round(avg(ex::int), 6) as exit_rate from r group by 1, 2""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_s(spark, d)
    rows = p.select("cik", "as_of_date").join(P.exit_frame(p).select("cik", "last_row", "last_refresh", "vintage"), "cik")
    defs = F.array(*(F.struct(F.lit(n).alias("definition"), F.add_months(a, m).alias("exits"), F.lit(k).alias("stale_kept")) for n, a, m, k in _DEFS))
    rows = rows.withColumn("d", F.explode(defs)).withColumn("horizon", F.explode(F.array(*map(F.lit, _HORIZONS)))).withColumn("until", F.expr("add_months(as_of_date, 3 * horizon)"))
    rows = rows.where("until <= vintage and (d.stale_kept or as_of_date <= last_refresh)")
    return rows.groupBy("d.definition", "horizon").agg(F.count("*").alias("n"), R(F.avg((F.col("d.exits") <= F.col("until")).cast("double")), 6).alias("exit_rate"))


@query("a13_quantile_summary", V.with_views("panel_c") + """ select sector, count(*) as n, round(quantile_cont(revenue, 0.1), 8) as p10, round(quantile_cont(revenue, 0.25), 8) as p25, round(median(revenue), 8) as p50, round(quantile_cont(revenue, 0.75), 8) as p75, round(quantile_cont(revenue, 0.9), 8) as p90, round(avg(revenue), 4) as mean from panel_c group by 1 having count(*) >= 5""")
def a13(spark: SparkSession, d: str) -> DataFrame:
    x = V.panel_c(spark, d)
    g = null_safe(x.groupBy("sector").agg(F.count("*").alias("n"), F.avg("revenue").alias("mean")).where("n >= 5"), quantiles(x, "revenue", ["sector"], [0.1, 0.25, 0.5, 0.75, 0.9]), ["sector"], "left")
    return g.select("sector", "n", *(R(F.col("q")[k], 8).alias(c) for k, c in enumerate(("p10", "p25", "p50", "p75", "p90"))), R("mean", 4).alias("mean"))


_MET = ("revenue", "gross_margin", "net_margin", "altman_z")


@query("a14_cohort_medians", V.with_views("panel_s") + ", l as (" + " union all ".join(f"select sector, '{m}' as metric, {m} as v from panel_s" for m in _MET) + ") select sector, metric, count(v) as n, round(median(v), 6) as median from l group by 1, 2")
def a14(spark: SparkSession, d: str) -> DataFrame:
    long = V.panel_s(spark, d).unpivot(["sector"], list(_MET), "metric", "v")
    mid = quantiles(long, "v", ["sector", "metric"], [0.5])
    return null_safe(long.groupBy("sector", "metric").agg(F.count("v").alias("n")), mid, ["sector", "metric"], "left").select("sector", "metric", "n", R(F.col("q")[0], 6).alias("median"))


@query("a15_share_with_total", V.with_views("panel_s") + """ select coalesce(sector, 'all') as sector, count(*) as n, round(avg((altman_z is not null)::int), 6) as covered from panel_s group by rollup (sector)""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    g = V.panel_s(spark, d).rollup("sector").agg(F.count("*").alias("n"), R(F.avg(F.col("altman_z").isNotNull().cast("double")), 6).alias("covered"))
    return g.withColumn("sector", F.coalesce("sector", F.lit("all")))


@query("a18_exit_by_bucket", DEC_S + f""", g as (select cik, max(year) my from dec group by 1) select {_B} as bucket, count(*) as n, round(avg((my <= year + 1)::int), 6) as gone from dec join g using (cik) group by 1""")
def a18(spark: SparkSession, d: str) -> DataFrame:
    x = dec_s(spark, d)
    x = x.withColumn("my", F.max("year").over(Window.partitionBy("cik")))
    return x.groupBy(P.fixed_buckets(F.col("health_score"), EDGES).alias("bucket")).agg(F.count("*").alias("n"), R(F.avg((F.col("my") <= F.col("year") + 1).cast("double")), 6).alias("gone"))


@query("a19_sector_distance", V.with_views("panel_c") + """, c as (select sector, count(*) filter (where qi < 7988)::double a, count(*) filter (where qi >= 7988)::double b from panel_c group by 1) select round(0.5 * sum(abs(a / (select sum(a) from c) - b / (select sum(b) from c))), 6) as tv from c""")
def a19(spark: SparkSession, d: str) -> DataFrame:
    c = V.panel_c(spark, d).groupBy("sector").agg(F.count_if(F.expr("qi < 7988")).cast("double").alias("a"), F.count_if(F.expr("qi >= 7988")).cast("double").alias("b"))
    w = Window.partitionBy()
    return c.withColumn("x", F.abs(F.col("a") / F.sum("a").over(w) - F.col("b") / F.sum("b").over(w))).agg(R(0.5 * F.sum("x"), 6).alias("tv"))


_VINT = DEC_S + """, v as (select cik, year, revenue as first_value, round(revenue * (1 + 0.04 * ((cik * 7 + year) % 5 - 2)), 4) as last_value from dec),
 r as (select *, abs(last_value / first_value - 1) as rel, row_number() over (partition by year order by first_value, cik) ra, row_number() over (partition by year order by last_value, cik) rb, count(*) over (partition by year) n from v),
 q as (select *, greatest(1, least(5, ceil(ra::double / n * 5)))::int qa, greatest(1, least(5, ceil(rb::double / n * 5)))::int qb from r where n >= 5)"""


@query("a21_vintage_divergence", _VINT + """ select year, count(*) as n, round(avg((rel >= 0.01)::int), 6) as ge_1, round(avg((rel >= 0.05)::int), 6) as ge_5, round(avg((qa <> qb)::int), 6) as flipped,
 round(count(*) filter (where qa = 5 and qb = 5)::double / count(*) filter (where qa = 5 or qb = 5), 6) as jaccard from q group by 1""")
def a21(spark: SparkSession, d: str) -> DataFrame:
    v = dec_s(spark, d).select("cik", "year", F.col("revenue").alias("first_value"), R(F.col("revenue") * (1 + 0.04 * ((F.col("cik") * 7 + F.col("year")) % 5 - 2)), 4).alias("last_value"))
    q = P.qcut_within(P.qcut_within(v, "first_value", "year", ["cik"], 5, 1, "qa"), "last_value", "year", ["cik"], 5, 1, "qb").where("qa is not null")
    rel, share = F.abs(F.col("last_value") / F.col("first_value") - 1), lambda c: R(F.avg(c.cast("double")), 6)
    both, either = F.count_if(F.expr("qa = 5 and qb = 5")), F.count_if(F.expr("qa = 5 or qb = 5"))
    return q.groupBy("year").agg(F.count("*").alias("n"), share(rel >= 0.01).alias("ge_1"), share(rel >= 0.05).alias("ge_5"), share(F.col("qa") != F.col("qb")).alias("flipped"), R(both / either, 6).alias("jaccard"))


@query("a27_direct_standardisation", V.with_views("panel_c") + """, x as (select sector, qi >= 7988 as late, (n_orders > 1)::int as hit from panel_c), s as (select sector, avg(hit) filter (where late) ra, avg(hit) filter (where not late) rb, count(*) filter (where late)::double na, count(*) filter (where not late)::double nb from x group by 1)
 select round(sum(ra * na) / sum(na), 6) as crude_late, round(sum(rb * nb) / sum(nb), 6) as crude_early, round(sum(ra * nb) / sum(nb), 6) as late_at_early_mix, round(sum(rb * na) / sum(na), 6) as early_at_late_mix from s""")
def a27(spark: SparkSession, d: str) -> DataFrame:
    late, hit = F.col("qi") >= 7988, (F.col("n_orders") > 1).cast("double")
    s = V.panel_c(spark, d).groupBy("sector").agg(F.avg(F.when(late, hit)).alias("ra"), F.avg(F.when(~late, hit)).alias("rb"), F.count_if(late).cast("double").alias("na"), F.count_if(~late).cast("double").alias("nb"))
    mix = lambda r, n: R(F.sum(F.col(r) * F.col(n)) / F.sum(n), 6)
    return s.agg(mix("ra", "na").alias("crude_late"), mix("rb", "nb").alias("crude_early"), mix("ra", "nb").alias("late_at_early_mix"), mix("rb", "na").alias("early_at_late_mix"))


@query("a33_exit_timing", EXIT + """ select year(last_row)::int as drop_year, quarter(last_row)::int as drop_quarter, count(*) as n, round(median((year(last_row) * 4 + quarter(last_row)) - (year(last_refresh) * 4 + quarter(last_refresh))), 6) as stale_median, round(avg((last_row - first_row) < 730)::double, 6) as young from (select *, case when (last_row - first_row) < 730 then 1 else 0 end as yg from firms) group by 1, 2""".replace("round(avg((last_row - first_row) < 730)::double, 6) as young", "round(avg(yg), 6) as young"))
def a33(spark: SparkSession, d: str) -> DataFrame:
    f = P.exit_frame(V.panel_s(spark, d))
    return f.groupBy(F.year("last_row").alias("drop_year"), F.quarter("last_row").alias("drop_quarter")).agg(F.count("*").alias("n"), R(F.median("stale_tail_quarters"), 6).alias("stale_median"), R(F.avg((F.datediff("last_row", "first_row") < 730).cast("double")), 6).alias("young"))


# means of two or three numbers of 8 digits: they end after 9 digits or never, so none is near a tie at 10
@query("r9_presample_label", DEC_S + """, l as (select cik, avg(gross_margin) lab from dec where year between 1995 and 1997 group by 1 having count(*) >= 2) select d.cik, d.year, round(lab, 10) as label, d.gross_margin as value from dec d join l using (cik) where year between 1999 and 2001""")
def r9(spark: SparkSession, d: str) -> DataFrame:
    return P.presample_label(dec_s(spark, d), "gross_margin", (1995, 1997), (1999, 2001)).select("cik", "year", R("label", 10).alias("label"), F.col("gross_margin").alias("value"))


@query("j18_first_print", V.with_views("panel_s") + """, f as (select cik, fiscal_year, min(as_of_date) as first_seen, arg_min(net_margin, as_of_date) as first_value, arg_max(net_margin, as_of_date) as last_value from panel_s where month(as_of_date) = 12 group by 1, 2)
 select * from f where cik in (select cik from f group by 1 having count(*) >= 5)""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    f = V.panel_s(spark, d).where("month(as_of_date) = 12").groupBy("cik", "fiscal_year").agg(F.min("as_of_date").alias("first_seen"), F.min_by("net_margin", "as_of_date").alias("first_value"), F.max_by("net_margin", "as_of_date").alias("last_value"))
    return f.join(f.groupBy("cik").count().where("count >= 5").select("cik"), "cik", "left_semi")


@query("j19_future_revisions", V.with_views("panel_s", "revisions") + """, s as (select ticker from panel_s group by 1) select s.ticker, count(r.rel) as n_revisions, coalesce(max(abs(r.rel)), 0) as worst from s left join revisions r on s.ticker = r.ticker and r.filed > date '2001-06-30' group by 1""")
def j19(spark: SparkSession, d: str) -> DataFrame:
    later = V.revisions(spark, d).where("changedFiled > '2001-06-30'").groupBy("ticker").agg(F.count("relDelta").alias("n"), F.max(F.abs("relDelta")).alias("w"))
    firms = V.panel_s(spark, d).select("ticker").distinct()
    return firms.join(later, "ticker", "left").select("ticker", F.coalesce("n", F.lit(0)).alias("n_revisions"), F.coalesce("w", F.lit(0.0)).alias("worst"))


@query("w8_growth_surprise", UNI_C + """, y as (select cik, fiscal_year, arg_min(revenue, qi) as rev from uni group by 1, 2) select a.cik, a.fiscal_year, round((a.rev / b.rev - 1) - (b.rev / c.rev - 1), 6) as surprise from y a join y b on a.cik = b.cik and a.fiscal_year = b.fiscal_year + 1 join y c on a.cik = c.cik and a.fiscal_year = c.fiscal_year + 2""")
def w8(spark: SparkSession, d: str) -> DataFrame:
    y = P.universe(V.panel_c(spark, d)).groupBy("cik", "fiscal_year").agg(F.min_by("revenue", "qi").alias("rev"))
    before = lambda k: y.select("cik", (F.col("fiscal_year") + k).alias("fiscal_year"), F.col("rev").alias(f"rev{k}"))
    z = y.join(before(1), ["cik", "fiscal_year"]).join(before(2), ["cik", "fiscal_year"])
    return z.select("cik", "fiscal_year", R((F.col("rev") / F.col("rev1") - 1) - (F.col("rev1") / F.col("rev2") - 1), 6).alias("surprise"))


@query("w9_within_firm_z", V.with_views("panel_s") + """ select cik, as_of_date, round((gross_margin - avg(gross_margin) over w) / nullif(stddev_samp(gross_margin) over w, 0), 5) as z from panel_s window w as (partition by cik)""")
def w9(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("cik")
    return V.panel_s(spark, d).select("cik", "as_of_date", R(F.try_divide(F.col("gross_margin") - F.avg("gross_margin").over(w), F.stddev_samp("gross_margin").over(w)), 5).alias("z"))


@query("l1_extremes_by_score", V.with_views("panel_s") + """ (select 'low' as side, cik, as_of_date, net_margin from panel_s order by net_margin, cik, as_of_date limit 50) union all (select 'high', cik, as_of_date, net_margin from panel_s order by net_margin desc, cik, as_of_date limit 50)""")
def l1(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_s(spark, d).select("cik", "as_of_date", "net_margin")
    low, high = p.orderBy("net_margin", "cik", "as_of_date").limit(50), p.orderBy(F.desc("net_margin"), "cik", "as_of_date").limit(50)
    return low.withColumn("side", F.lit("low")).unionByName(high.withColumn("side", F.lit("high")))


@query("a43_spearman", V.with_views("panel_s") + """, x as (select sector, revenue as a, health_score as b, cik, as_of_date from panel_s), r as (select sector, rank() over (partition by sector order by a) + (count(*) over (partition by sector, a) - 1) / 2 as ra, rank() over (partition by sector order by b) + (count(*) over (partition by sector, b) - 1) / 2 as rb from x) select sector, count(*) as n, round(corr(ra, rb), 6) as rho from r group by 1""")
def a43(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.variance import spearman

    return spearman(V.panel_s(spark, d), "revenue", "health_score", ["sector"]).select("sector", "n", R("rho", 6).alias("rho"))


@query("v16_winsorised", DEC_S + """, e as (select year, quantile_cont(altman_z, 0.01) lo, median(altman_z) mid, quantile_cont(altman_z, 0.99) hi from dec group by 1) select cik, year, altman_z is null as altman_z_missing, round(coalesce(least(greatest(altman_z, lo), hi), mid), 6) as altman_z from dec join e using (year)""".replace("least(greatest(altman_z, lo), hi)", "case when altman_z is not null then least(greatest(altman_z, lo), hi) end"))
def v16(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.variance import winsorise

    out = winsorise(dec_s(spark, d).select("cik", "year", "altman_z"), ["altman_z"], ["year"])
    return out.select("cik", "year", "altman_z_missing", R("altman_z", 6).alias("altman_z"))
