"""Share-count, valuation, name and nested-record queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import LEGAL, STOPWORDS, core, usable
from ..operators import asof as A
from ..operators import names as N
from ..operators import shares as S
from ..sources import readers as I
from ..sources import schemas
from ..sources import views as V
from .panel_queries import R

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None):
    def keep(fn):
        Q[name] = (fn, sql)
        return fn

    return keep


_FLAG = V.with_views("share_series") + """, l as (select cik, fiscal_year, diluted, lag(fiscal_year) over w py, lag(diluted) over w ps from shares where diluted <> 0 window w as (partition by cik order by fiscal_year)), r as (select cik, fiscal_year as flag_year, diluted / ps as ratio from l where fiscal_year - py = 1),
 nn as (select * from (values (2,1),(3,2),(4,3),(5,4),(6,5),(7,6),(8,7),(10,8),(20,9)) t(n, o)), c as (select r.*, case when abs(ratio - n) <= n * 0.06 then n::double when abs(ratio - 1.0 / n) <= 0.06 / n then (1.0::double / n) end as factor, o from r, nn), f as (select cik, flag_year, ratio, arg_min(factor, o) as factor from c where factor is not null group by 1, 2, 3)"""


def flags(spark: SparkSession, d: str) -> DataFrame:
    return S.split_basis_flags(V.share_series(spark, d).select("cik", "fiscal_year", F.col("diluted").alias("shares")))


@query("w5_split_flags", _FLAG + " select cik, flag_year, round(ratio, 9) as ratio, factor from f")
def w5(spark: SparkSession, d: str) -> DataFrame:
    return flags(spark, d).select("cik", "flag_year", R("ratio", 9).alias("ratio"), "factor")


_CORR = _FLAG + """, so as (select cik, fiscal_year y, outstanding v from shares where outstanding > 0), b as (select f.*, max(y) filter (where y <= flag_year) as baseline_year from f left join so using (cik) group by 1, 2, 3, 4),
 bb as (select b.*, so.v base from b left join so on so.cik = b.cik and so.y = baseline_year), a as (select bb.*, so.y as sy, so.v / base as r from bb left join so on so.cik = bb.cik and so.y between flag_year + 1 and flag_year + 3),
 g as (select cik, flag_year, factor, baseline_year, min(sy) filter (where r between 0.7 * factor and 1.4 * factor) hit, arg_min(sy, abs(ln(r / factor)) * 1e6 + sy * 1e-3) filter (where r is not null) near from a group by 1, 2, 3, 4)"""


@query("v5_corroborated_flags", _CORR + " select cik, flag_year, factor, baseline_year, coalesce(hit, near) as step_year, case when hit is not null then 'corroborated' when near is not null then 'contradicted' else 'untestable' end as verdict from g")
def v5(spark: SparkSession, d: str) -> DataFrame:
    so = V.share_series(spark, d).select("cik", "fiscal_year", F.col("outstanding").alias("shares"))
    return S.corroborate_flags(flags(spark, d), so).select("cik", "flag_year", "factor", "baseline_year", "step_year", "verdict")


@query("v7_series_sanity", V.with_views("share_series") + " select cik, fiscal_year, outstanding, diluted, round(outstanding / diluted, 9) as ratio from shares where outstanding > 0 and diluted > 0 and not (outstanding / diluted between 0.5 and 2.0)")
def v7(spark: SparkSession, d: str) -> DataFrame:
    return S.series_sanity(V.share_series(spark, d)).withColumn("ratio", R("ratio", 9))


_BASIS = V.with_views("share_series") + """, r as (select *, outstanding / diluted as ratio from shares), fl as (select *, fiscal_year - row_number() over (partition by cik order by fiscal_year) g from r where not (ratio between 0.5 and 2.0)),
 runs as (select cik, min(fiscal_year) first_year, max(fiscal_year) last_year, count(*) run_len, 1 / median(ratio) fw from fl group by cik, g), st as (select runs.*, a.outstanding / b.outstanding as step from runs left join shares a on a.cik = runs.cik and a.fiscal_year = last_year + 1 left join shares b on b.cik = runs.cik and b.fiscal_year = last_year),
 ok as (select *, coalesce(run_len <= 2 and fw between 1.0 / 60 and 60 and abs(ln(step / fw)) < abs(ln(step)), false) as resolved from st),
 basis as (select cik, first_year, last_year, run_len, last_year + 1 as split_year, case when resolved then sqrt(fw * step) end as rawf, resolved from ok),
 cand as (select c::double as c from (select unnest([2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 25, 30, 40, 50, 100, 1.5]) c) union all select 1.0::double / c from (select unnest([2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 25, 30, 40, 50, 100, 1.5]) c)),
 sn as (select basis.*, (select arg_min(c, abs(ln(rawf / c))) from cand) as near from basis), bas as (select *, case when resolved then case when abs(ln(rawf / near)) < 0.1 then near else rawf end end as factor from sn)"""


@query("v9_firm_basis", _BASIS + " select cik, first_year, last_year, run_len, split_year, round(factor, 9) as factor, resolved from bas")
def v9(spark: SparkSession, d: str) -> DataFrame:
    s = V.share_series(spark, d).withColumn("implied", F.lit(None).cast("double"))
    return S.firm_basis(s).select("cik", "first_year", "last_year", "run_len", "split_year", R("factor", 9).alias("factor"), "resolved")


@query("v6_rebased_counts", _BASIS + " select s.cik, s.fiscal_year, round(s.outstanding * coalesce(product(b.factor), 1), 6) as rebased from shares s left join bas b on b.cik = s.cik and b.resolved and s.fiscal_year < b.split_year group by s.cik, s.fiscal_year, s.outstanding")
def v6(spark: SparkSession, d: str) -> DataFrame:
    s = V.share_series(spark, d)
    splits = S.firm_basis(s.withColumn("implied", F.lit(None).cast("double"))).where("resolved").select("cik", "split_year", "factor")
    return S.rebase(s.select("cik", "fiscal_year", F.col("outstanding").alias("shares")), splits).select("cik", "fiscal_year", R("rebased", 6).alias("rebased"))


@query("v8_snapped_ratios", V.with_views("share_series") + """, r as (select *, outstanding / diluted as ratio from shares), cand as (select c::double as c from (select unnest([2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 25, 30, 40, 50, 100, 1.5]) c) union all select 1.0::double / c from (select unnest([2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 25, 30, 40, 50, 100, 1.5]) c)),
 q as (select cik, fiscal_year, ratio, (select arg_min(c, abs(ln(ratio / c))) from cand) as near from r) select cik, fiscal_year, round(case when abs(ln(ratio / near)) < 0.1 then near else ratio end, 9) as factor, abs(ln(ratio / near)) < 0.1 as snapped from q""")
def v8(spark: SparkSession, d: str) -> DataFrame:
    rows = V.share_series(spark, d).withColumn("s", S.snap(F.col("outstanding") / F.col("diluted")))
    return rows.select("cik", "fiscal_year", R("s.factor", 9).alias("factor"), "s.snapped")


_CAP = V.with_views("share_series", "bars") + """, s as (select cik, fiscal_year, outstanding, make_date(fiscal_year, 6, 30) as pe, make_date(fiscal_year, 12, 31) as as_of, 'S' || (cik % 10) as ticker from shares), c as (select s.*, case when as_of - date <= 14 then close end as px from s asof left join bars on s.ticker = bars.ticker and s.as_of >= bars.date)"""


@query("v11_market_cap", _CAP + " select cik, fiscal_year, case when pe < as_of and outstanding > 0 and px > 0 then round(outstanding * px, 6) end as cap from c")
def v11(spark: SparkSession, d: str) -> DataFrame:
    s = V.share_series(spark, d).withColumn("as_of", F.make_date("fiscal_year", F.lit(12), F.lit(31))).withColumn("ticker", F.concat(F.lit("S"), F.pmod("cik", F.lit(10))))
    out = A.close_at(V.bars(spark, d), s.select("cik", "fiscal_year", "outstanding", "ticker", "as_of"), day="as_of")
    cap = S.market_cap(F.col("outstanding"), F.col("px"), F.make_date("fiscal_year", F.lit(6), F.lit(30)), F.col("as_of"))
    return out.select("cik", "fiscal_year", R(cap, 6).alias("cap"))


@query("v12_valuation_decomposition", _CAP + """, r as (select l_partkey as cik, year(l_shipdate)::int as fiscal_year, round(sum(l_extendedprice), 4) as rev from lineitem group by 1, 2), x as (select c.cik, c.fiscal_year, px, outstanding, rev from c join r using (cik, fiscal_year) where px is not null),
 g as (select cik, min(fiscal_year) y0, max(fiscal_year) y1 from x group by 1), h as (select g.cik, y0, y1, a.px p0, b.px p1, a.outstanding s0, b.outstanding s1, a.rev r0, b.rev r1 from g join x a on a.cik = g.cik and a.fiscal_year = y0 join x b on b.cik = g.cik and b.fiscal_year = y1 where y1 > y0)
 select cik, y0, y1, round(p1 / p0, 8) as ret, round((r1 / s1) / (r0 / s0), 8) as rps, round((p1 / p0) / ((r1 / s1) / (r0 / s0)), 8) as mult from h""")
def v12(spark: SparkSession, d: str) -> DataFrame:
    s = V.share_series(spark, d).withColumn("as_of", F.make_date("fiscal_year", F.lit(12), F.lit(31))).withColumn("ticker", F.concat(F.lit("S"), F.pmod("cik", F.lit(10))))
    priced = A.close_at(V.bars(spark, d), s.select("cik", "fiscal_year", "outstanding", "ticker", "as_of"), day="as_of").where("px is not null")
    rev = V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cik"), F.year("l_shipdate").alias("fiscal_year")).agg(R(F.sum("l_extendedprice"), 4).alias("rev"))
    row = F.struct("px", "outstanding", "rev")
    g = priced.join(rev, ["cik", "fiscal_year"]).groupBy("cik").agg(F.min("fiscal_year").alias("y0"), F.max("fiscal_year").alias("y1"), F.min_by(row, "fiscal_year").alias("a"), F.max_by(row, "fiscal_year").alias("z")).where("y1 > y0")
    x = S.decompose(F.col("a.px"), F.col("z.px"), F.col("a.rev"), F.col("z.rev"), F.col("a.outstanding"), F.col("z.outstanding"))
    return g.withColumn("x", x).select("cik", "y0", "y1", *(R(F.col(f"x.{c}"), 8).alias(c) for c in ("ret", "rps", "mult")))


@query("a26_cohort_price_to_sales", _CAP + """, r as (select l_partkey as cik, year(l_shipdate)::int as fiscal_year, sum(l_extendedprice) as rev from lineitem group by 1, 2) select fiscal_year, round(sum(outstanding * px), 2) as cap, round(sum(rev), 2) as rev, round(sum(outstanding * px) / sum(rev), 8) as ps from c join r using (cik, fiscal_year) where px is not null group by 1""")
def a26(spark: SparkSession, d: str) -> DataFrame:
    s = V.share_series(spark, d).withColumn("as_of", F.make_date("fiscal_year", F.lit(12), F.lit(31))).withColumn("ticker", F.concat(F.lit("S"), F.pmod("cik", F.lit(10))))
    priced = A.close_at(V.bars(spark, d), s.select("cik", "fiscal_year", "outstanding", "ticker", "as_of"), day="as_of").where("px is not null")
    rev = V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cik"), F.year("l_shipdate").alias("fiscal_year")).agg(F.sum("l_extendedprice").alias("rev"))
    cap = F.sum(F.col("outstanding") * F.col("px"))
    return priced.join(rev, ["cik", "fiscal_year"]).groupBy("fiscal_year").agg(R(cap, 2).alias("cap"), R(F.sum("rev"), 2).alias("rev"), R(cap / F.sum("rev"), 8).alias("ps"))


_CORE = r"""array_to_string(list_filter(string_split_regex(regexp_replace(replace(lower(nm), '&', ' and '), '[\\/][a-z]{2,4}[\\/]?\s*$|\bet\s+al\b', ' ', 'g'), '[^a-z0-9]+'), lambda t: t <> '' and not list_contains(""" + str(LEGAL) + """, t)), ' ')"""
#: Names of parts as companies: candidates are the alias, the alias with a word more, with a word less that may go, or one word with a letter more.
_NAMES_SQL = """with nb as (select p_partkey as k, case when p_partkey % 5 = 4 then 'veloria' || translate(p_partkey::text, '0123456789', 'abcdefghij') else p_name || ' k' || p_partkey end as base from part),
 al as (select k as key, base || case k % 4 when 0 then ' Inc' when 1 then ' & Co /DE/' when 2 then ', Ltd.' else ' Systems' end as nm from nb),
 cd as (select distinct base || case when k % 5 = 4 then case k % 3 when 0 then 'x' when 1 then ' Corp' else 'xy LLC' end else case k % 3 when 0 then ' Corp' when 1 then ' Japan' else ' Holdings' end end as nm from nb)"""


def name_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    single = F.concat(F.lit("veloria"), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    p = V.table(spark, d, "part").select(k.alias("key"), F.when(k % 5 == 4, single).otherwise(F.concat("p_name", F.lit(" k"), k.cast("string"))).alias("base"))
    k = F.col("key")
    a = F.concat("base", F.when(k % 4 == 0, " Inc").when(k % 4 == 1, " & Co /DE/").when(k % 4 == 2, ", Ltd.").otherwise(" Systems"))
    one = F.when(k % 3 == 0, "x").when(k % 3 == 1, " Corp").otherwise("xy LLC")
    c = F.concat("base", F.when(k % 5 == 4, one).otherwise(F.when(k % 3 == 0, " Corp").when(k % 3 == 1, " Japan").otherwise(" Holdings")))
    return p.select("key", a.alias("alias")), p.select(c.alias("candidate")).distinct()


@query("n1_name_cores", _NAMES_SQL + f" select key, {_CORE} as core from al")
def n1(spark: SparkSession, d: str) -> DataFrame:
    return name_tables(spark, d)[0].select("key", core(F.col("alias")).alias("core"))


@query("n2_usable_names", _NAMES_SQL + f", c as (select key, {_CORE} as core from al) select count(*) as n, count(*) filter (where core like '% %' or length(core) >= 5) as usable, count(distinct core) as cores from c")
def n2(spark: SparkSession, d: str) -> DataFrame:
    c = name_tables(spark, d)[0].select(core(F.col("alias")).alias("core"))
    return c.agg(F.count("*").alias("n"), F.count_if(usable(F.col("core"))).alias("usable"), F.count_distinct("core").alias("cores"))


#: The rules on cores, written out over the words of both. Pairs meet on what every rule needs: the first word, or six letters of a single one.
_RULE = """case when ac = cc then 'R1' when not contains(ac, ' ') and not contains(cc, ' ') and (starts_with(ac, cc) or starts_with(cc, ac)) and least(length(ac), length(cc)) >= 6 and abs(length(ac) - length(cc)) between 1 and 2
 and least(length(ac), length(cc)) >= 0.7 * greatest(length(ac), length(cc)) then 'R2' when aw[1] <> cw[1] then null
 when len(list_filter(aw, lambda t: not list_contains(cw, t))) = 0 and len(list_distinct(list_filter(cw, lambda t: not list_contains(aw, t)))) between 1 and 2 and (len(list_distinct(aw)) >= 2 or (length(aw[1]) >= 6 and not list_contains(st, aw[1]))) then 'R3'
 when len(list_filter(cw, lambda t: not list_contains(aw, t))) = 0 and len(list_filter(aw, lambda t: not list_contains(cw, t) and length(t) > 2 and not list_contains(st, t))) = 0 and len(list_filter(aw, lambda t: not list_contains(cw, t))) > 0
 and (len(list_distinct(cw)) >= 2 or (length(cw[1]) >= 6 and not list_contains(st, cw[1]))) then 'R3b' end"""
_USABLE = "{c} <> '' and (contains({c}, ' ') or (length({c}) >= 5 and not list_contains({st}, {c}) and not regexp_full_match({c}, '[0-9]+')))"


def _match_sql(stop: list[str]) -> str:
    return _NAMES_SQL + f""", a as (select key, {_CORE} as ac from al), c as (select nm as candidate, {_CORE} as cc from cd),
 u as (select *, string_split(ac, ' ') as aw from a where {_USABLE.format(c="ac", st=stop)}), v as (select *, string_split(cc, ' ') as cw, {stop} as st from c where {_USABLE.format(c="cc", st=stop)}),
 m as (select key, candidate, ac, cc, aw, cw, st from u join v on aw[1] = cw[1] or left(ac, 6) = left(cc, 6)), p as (select key, candidate, {_RULE} as rule from m),
 q as (select * from p where rule is not null), o as (select candidate from q group by 1 having count(distinct key) > 1)
 select key, candidate, rule from q where candidate not in (select candidate from o)"""


@query("n4_name_match", _match_sql(STOPWORDS))
def n4(spark: SparkSession, d: str) -> DataFrame:
    return N.match(*name_tables(spark, d)).select("key", "candidate", "rule")


@query("n5_extra_stopwords", _match_sql([*STOPWORDS, "japan", "ring", "widget"]))
def n5(spark: SparkSession, d: str) -> DataFrame:
    return N.match(*name_tables(spark, d), extra_stopwords=["japan", "ring", "widget"]).select("key", "candidate", "rule")


@query("j13_lookup_outcome", V.with_views("panel_c", "listed_holders") + """, f as (select cik, ticker, max(as_of_date) last_row from panel_c group by 1, 2), h as (select ticker, list(distinct cik) cs from listed_holders group by 1) select f.cik, f.ticker, case when cs is null then 'nothing' when list_contains(cs, f.cik) then 'asked for' else 'different company' end as outcome from f left join h using (ticker)""")
def j13(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_c(spark, d)
    return N.lookup_outcome(p.select("cik", "ticker").distinct(), V.listed_holders(spark, d)).select("cik", "ticker", "outcome")


@query("j14_landing", V.with_views("panel_c") + """, f as (select cik, ticker, max(as_of_date) last_row from panel_c group by 1, 2), sp as (select ticker, cik as rc, min(as_of_date) fs from panel_c group by 1, 2), a as (select f.*, cik + case when cik % 20 = 18 then 1 when cik % 20 = 19 then -1 else 2 end as rc from f)
 select a.cik, a.rc as returned_cik, case when fs is null then 'absent' when fs > last_row then 'later' else 'earlier or overlapping' end as landing, (fs - last_row)::int as gap_days from a left join sp on sp.ticker = a.ticker and sp.rc = a.rc""")
def j14(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_c(spark, d)
    asked = p.groupBy("cik", "ticker").agg(F.max("as_of_date").alias("last_row")).withColumn("returned_cik", F.expr("cik + case when cik % 20 = 18 then 1 when cik % 20 = 19 then -1 else 2 end"))
    return N.landing(asked, p).select("cik", "returned_cik", "landing", "gap_days")


_JSON = "with y as (select o_custkey as cik, year(o_orderdate)::int as fy, max(o_orderdate::date) as pe, round(sum(o_totalprice), 4) as rev from orders group by 1, 2)"


def history(spark: SparkSession, d: str) -> DataFrame:
    """Per-company JSON documents made from orders, read back through the declared schema."""
    o = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cik"), F.year("o_orderdate").alias("fy")).agg(F.max(F.to_date("o_orderdate")).alias("pe"), R(F.sum("o_totalprice"), 4).alias("rev"))
    docs = o.groupBy("cik").agg(F.collect_list(F.struct(F.col("fy").alias("fiscalYear"), F.col("pe").cast("string").alias("periodEnd"), F.col("rev").alias("revenue"))).alias("years"))
    text = docs.select(F.to_json(F.struct(F.col("cik").alias("cikNumber"), "years")).alias("value"))
    return text.select(F.from_json("value", schemas.HISTORY).alias("d")).select("d.*")


@query("s9_fiscal_years_from_json", _JSON + " select cik, fy as fiscal_year, pe as period_end, (fy - year(pe))::int as year_offset, strftime(pe, '%m-%d') as month_day from y")
def s9(spark: SparkSession, d: str) -> DataFrame:
    return I.fiscal_years(history(spark, d))


@query("s10_fundamentals_from_json", _JSON + " select cik, fy as fiscal_year, pe as period_end, rev as revenue from y")
def s10(spark: SparkSession, d: str) -> DataFrame:
    return I.fundamentals(history(spark, d)).select("cik", "fiscal_year", "period_end", "revenue")


@query("s7_registrants_from_json", "with r as (select c_custkey as i, c_custkey // 2 as cik, 'T' || (c_custkey // 3) as t, c_name as title from customer) select cik, arg_min(title, i) as name, count(distinct t) as n_tickers from r group by 1")
def s7(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.floor(F.col("c_custkey") / 2).alias("cik_str"), F.concat(F.lit("T"), F.floor(F.col("c_custkey") / 3)).alias("ticker"), F.col("c_name").alias("title"))
    # one JSON object for each hundred entries, as a list cut into files
    text = c.groupBy(F.floor(F.col("i") / 100)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("string"), F.struct("cik_str", "ticker", "title"))))).alias("value"))
    reg = I.registrants(text)
    return reg.select("cik", "name", F.size("tickers").cast("long").alias("n_tickers"))


@query("s8_ticker_holders", "with r as (select c_custkey // 2 as cik, 'T' || (c_custkey // 3) as t from customer) select t as ticker, count(distinct cik) as n_ciks, min(cik) as first_cik from r group by 1")
def s8(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "customer")
    reg = c.groupBy(F.floor(F.col("c_custkey") / 2).alias("cik")).agg(F.collect_set(F.concat(F.lit("T"), F.floor(F.col("c_custkey") / 3))).alias("tickers"))
    return I.holders(reg).select("ticker", F.size("ciks").cast("long").alias("n_ciks"), F.col("ciks")[0].alias("first_cik"))


@query("s14_entity_sample", V.with_views("panel_c") + """, k as (select cik from (select distinct cik from panel_c) order by ('0x' || substr(md5('11|' || cik), 1, 8))::bigint, cik limit 40) select cik, as_of_date, revenue from panel_c where cik in (select cik from k)""")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return I.entity_sample(V.panel_c(spark, d), "cik", 40, 11).select("cik", "as_of_date", "revenue")


@query("s15_stratified_sample", V.with_views("panel_c") + """, k as (select cik, min(sector) stratum from panel_c group by 1), h as (select *, ('0x' || substr(md5('5|' || cik), 1, 8))::bigint as h from k), r as (select *, row_number() over (partition by stratum order by h, cik) rn from h) select cik, stratum from r order by (rn > 8)::int, h, cik limit 42""")
def s15(spark: SparkSession, d: str) -> DataFrame:
    return I.stratified_sample(V.panel_c(spark, d), "cik", "sector", 42, 5, 5)


@query("a29_item_sets", """with o as (select user_id as firm, ts::date as day, event_type from events), s as (select firm, day, list_sort(list_distinct(list(event_type))) as items from o group by 1, 2) select array_to_string(list_filter(items, lambda x: x <> 'view'), '+') as class, count(*) as n, count(distinct firm) as firms from s group by 1""")
def a29(spark: SparkSession, d: str) -> DataFrame:
    e = V.table(spark, d, "events").groupBy(F.col("user_id").alias("firm"), F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("items"))
    e = e.select("firm", F.array_join(F.array_sort(F.array_except("items", F.array(F.lit("view")))), "+").alias("class"))
    return e.groupBy("class").agg(F.count("*").alias("n"), F.count_distinct("firm").alias("firms"))


@query("w11_purchase_clusters", """with e as (select user_id % 20 as company, user_id as insider, ts, value from events where event_type = 'purchase'), g as (select *, case when ts - lag(ts) over (partition by company order by ts, insider) <= interval 6 hour then 0 else 1 end as fresh from e), s as (select *, sum(fresh) over (partition by company order by ts, insider rows unbounded preceding) as episode from g),
 x as (select company, episode, count(distinct insider) as insiders, max(value) as largest, min(ts)::date as day from s group by 1, 2) select company, insiders, round(largest, 6) as largest, day from x where insiders >= 2 or largest >= 400""")
def w11(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of a company's purchases no more than six hours apart: several insiders or one large row."""
    e = V.table(spark, d, "events").where("event_type = 'purchase'").select((F.col("user_id") % 20).alias("company"), F.col("user_id").alias("insider"), "ts", "value")
    w = Window.partitionBy("company").orderBy("ts", "insider")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 6 hours"), 0).otherwise(1)
    s = e.withColumn("fresh", fresh).withColumn("episode", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = s.groupBy("company", "episode").agg(F.count_distinct("insider").alias("insiders"), F.max("value").alias("largest"), F.to_date(F.min("ts")).alias("day"))
    return x.where("insiders >= 2 or largest >= 400").select("company", "insiders", R("largest", 6).alias("largest"), "day")


@query("s11_insider_pages", "with e as (select user_id as cik, case event_type when 'purchase' then 'P' when 'refund' then 'S' else 'A' end as code, event_id % 5 = 0 as deriv, value, ts::date as day from events) select cik, min(day) as covered_from, count(*) filter (where code in ('P', 'S') and not deriv and value <> 0) as open_market, round(sum(value) filter (where code = 'P' and not deriv and value <> 0), 6) as bought from e group by 1")
def s11(spark: SparkSession, d: str) -> DataFrame:
    """Insider pages as JSON documents, read through the declared schema."""
    code = F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "refund", "S").otherwise("A")
    t = F.struct(code.alias("code"), (F.col("event_id") % 5 == 0).alias("isDerivative"), "value", F.to_date("ts").cast("string").alias("transactionDate"))
    docs = V.table(spark, d, "events").groupBy(F.col("user_id").alias("cikNumber")).agg(F.collect_list(t).alias("transactions")).select(F.to_json(F.struct("cikNumber", "transactions")).alias("value"))
    rows = I.insider_transactions(docs.select(F.from_json("value", schemas.INSIDER).alias("d")).select("d.*"))
    return rows.groupBy("cik").agg(F.min("day").alias("covered_from"), F.count_if(F.col("open_market")).alias("open_market"), R(F.sum(F.when(F.col("open_market") & (F.col("code") == "P"), F.col("value"))), 6).alias("bought"))


@query("s12_latest_annual_value", "with o as (select o_custkey as cik, case when o_orderkey % 3 = 0 then 'Revenue' else 'Other' end as concept, round(o_totalprice, 4) as v, o_orderdate::date as filed, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders), r as (select cik, arg_min(v, rn) as value, arg_min(filed, rn) as filed_at from o where concept = 'Revenue' group by 1) select r.cik, value, filed_at, p.probe from r join (select cik, max(filed) as probe from o group by 1) p on p.cik = r.cik")
def s12(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("cik"), F.when(F.col("o_orderkey") % 3 == 0, "Revenue").otherwise("Other").alias("concept"), R("o_totalprice", 4).alias("v"), F.to_date("o_orderdate").alias("filed"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).alias("rn"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("rn", "concept", "v", "filed"))), lambda x: F.struct(x["concept"].alias("conceptGroup"), x["v"].alias("value"), x["filed"].cast("string").alias("filedAt")))
    docs = o.groupBy(F.col("cik").alias("cikNumber")).agg(values.alias("values")).select(F.to_json(F.struct("cikNumber", "values")).alias("value"))
    return I.latest_annual(docs.select(F.from_json("value", schemas.AS_OF).alias("d")).select("d.*")).select("cik", "value", "filed_at", "probe")


@query("a36_name_coverage", "with c as (select c_custkey as cik, c_mktsegment as source, case when c_custkey % 4 <> 0 then c_name end as name, case when c_custkey % 6 = 0 then ['old ' || c_name] else [] end as former, case when c_custkey % 5 <> 0 then ['T' || c_custkey] else [] end as tickers from customer) select source, count(*) as n, count(name) as named, count(*) filter (where len(former) > 0) as with_former, count(*) filter (where len(tickers) > 0) as still_listed from c group by 1")
def a36(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    some = lambda c, v: F.when(c, F.array(v)).otherwise(F.array().cast("array<string>"))
    c = V.table(spark, d, "customer").select(F.col("c_mktsegment").alias("source"), F.when(k % 4 != 0, F.col("c_name")).alias("name"), some(k % 6 == 0, F.concat(F.lit("old "), "c_name")).alias("former"), some(k % 5 != 0, F.concat(F.lit("T"), k)).alias("tickers"))
    return c.groupBy("source").agg(F.count("*").alias("n"), F.count("name").alias("named"), F.count_if(F.size("former") > 0).alias("with_former"), F.count_if(F.size("tickers") > 0).alias("still_listed"))


@query("n6_json_fields", "select event_type, count(*) as n, sum(json_extract(props, '$.k')::bigint)::bigint as total, count(*) filter (where json_extract(props, '$.none') is null) as without_field from events group by 1")
def n6(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return V.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.count_if(F.get_json_object("props", "$.none").isNull()).alias("without_field"))


@query("j7_benchmark_calendar", V.with_views("bars", "bench", "sparse_bench") + " select d.date, b.close as bench from (select distinct date from bars) d asof join sparse_bench b on d.date >= b.date")
def j7(spark: SparkSession, d: str) -> DataFrame:
    return A.calendar(V.bars(spark, d), V.sparse_bench(spark, d))
