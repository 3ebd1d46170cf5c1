"""Resampling, shuffle and matching queries and their oracles: the draws are hashes that both engines compute."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import FACTOR, ROUNDS, STEP, WORD, draw, mix
from ..operators import matching as M
from ..operators import nulls as N
from ..operators import panel as P
from ..operators import resample as B
from ..operators import variance as VA
from ..sources import views as V
from .panel_queries import DEC_S, R, dec_s

Q: dict[str, tuple] = {}
#: Draws of the bootstraps, of the tables of cells, and of label shuffles and other placebos.
BOOTS, CELLS, DRAWS = 1000, 300, 200


def recursive(sql: str) -> str:
    """SQL whose WITH may name the splitting tree."""
    return re.sub(r"^\s*with ", "with recursive ", sql) if " tr as (" in sql or " wk as (" in sql else sql


def query(name: str, sql: str | None):
    def keep(fn):
        Q[name] = (fn, recursive(sql) if sql else sql)
        return fn

    return keep


def _h(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8))::bigint"


def _mix(x: str) -> str:
    """functions.draws.mix in SQL."""
    for _ in range(2):
        x = f"((xor(({x}) >> 16, {x}) * {FACTOR}) & {WORD})"
    return f"xor({x} >> 16, {x})"


def _mult(rows: str, group: str, seed: int = 0, draws: int = BOOTS) -> str:
    """CTEs gi (indexed groups) and mu (draw, grp, w) over a CTE's groups: the splitting tree of functions.draws, level by level."""
    base = int(mix(np.uint64([seed]))[0])
    ends = "(p << (32 - lvl)) * g >> 32 as a, (((p + 1) << (32 - lvl)) - 1) * g >> 32 as z"
    word = _mix(f"(h + j * {STEP}) & {WORD}")
    left = f"list_sum(list_transform(range((n + 31) // 32), lambda j: bit_count(({word}) >> (32 - least(32, n - 32 * j)))))::bigint"
    return f"""gi as (select grp, row_number() over (order by grp) - 1 as idx, count(*) over () as n from (select distinct {group} as grp from {rows} where {group} is not null)),
 tr as (select d as draw, {_mix(f"xor({base}::bigint, d)")} as k, 0 as lvl, 0::bigint as p, g as n, g from range(1, {draws + 1}) t(d), (select max(n)::bigint as g from gi)
  union all select draw, k, lvl + 1, 2 * p + s, case s when 0 then l else n - l end, g from (select *, {left} as l from (select *, {_mix("xor(k, (1::bigint << lvl) | p)")} as h from (select *, {ends} from tr) where a <> z)), (values (0::bigint), (1)) sd(s) where case s when 0 then l else n - l end > 0),
 mu as (select draw, grp, sum(tr.n)::bigint as w from (select *, {ends} from tr) tr join gi on gi.idx = a where a = z group by 1, 2)"""


_G = DEC_S + ", src as (select cik, year, gross_margin as v, net_margin as u, case when altman_z is null then null when altman_z < 1 then 'a' else 'b' end as side from dec)"
#: A median weighted by whole numbers is the median of the repeated rows.
_REP = "select draw, {cols} unnest(list_transform(range(w), lambda i: v)) as v from {rows} join mu on mu.grp = {rows}.cik"


@query("r1_bootstrap_mean", _G + ", " + _mult("src", "cik") + ", st as (select draw, sum(v * w) / sum(w) as s from src join mu on mu.grp = src.cik group by 1) select (select round(avg(v), 9) from src) as obs, round(quantile_cont(s, 0.025), 9) as lo, round(quantile_cont(s, 0.975), 9) as hi from st")
def r1_mean(spark: SparkSession, d: str) -> DataFrame:
    out = B.cluster_bootstrap(dec_s(spark, d), "gross_margin", "cik", "mean", BOOTS)
    return out.select(*(R(c, 9).alias(c) for c in ("obs", "lo", "hi")))


@query("r1_bootstrap_median", _G + ", " + _mult("src", "cik") + ", rp as (" + _REP.format(cols="", rows="src") + "), st as (select draw, median(v) as s from rp group by 1) select (select round(median(v), 9) from src) as obs, round(quantile_cont(s, 0.025), 9) as lo, round(quantile_cont(s, 0.975), 9) as hi from st")
def r1_median(spark: SparkSession, d: str) -> DataFrame:
    out = B.cluster_bootstrap(dec_s(spark, d), "gross_margin", "cik", "median", BOOTS)
    return out.select(*(R(c, 9).alias(c) for c in ("obs", "lo", "hi")))


_SIDED = _G + ", sd as (select * from src where side is not null and v is not null), "


def sided(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("altman_z").isNull(), None).when(F.col("altman_z") < 1, "a").otherwise("b")
    return dec_s(spark, d).withColumn("side", side)


@query("r2_boot_diff_mean", _SIDED + _mult("sd", "cik") + """, st as (select draw, sum(v * w) filter (where side = 'a') / sum(w) filter (where side = 'a') - sum(v * w) filter (where side = 'b') / sum(w) filter (where side = 'b') as s, coalesce(sum(w) filter (where side = 'a'), 0) na, coalesce(sum(w) filter (where side = 'b'), 0) nb from sd join mu on mu.grp = sd.cik group by 1), ok as (select * from st where na >= 1 and nb >= 1)
 select (select round(avg(v) filter (where side = 'a') - avg(v) filter (where side = 'b'), 9) from sd) as obs, round(quantile_cont(s, 0.025), 9) as lo, round(quantile_cont(s, 0.975), 9) as hi, round(avg((s <= 0)::int), 9) as share_le_0 from ok""")
def r2_mean(spark: SparkSession, d: str) -> DataFrame:
    return B.cluster_boot_diff(sided(spark, d), "gross_margin", "cik", "side", "mean", BOOTS).select(*(R(c, 9).alias(c) for c in ("obs", "lo", "hi", "share_le_0")))


@query("r2_boot_diff_median_by_year", _SIDED + _mult("sd", "cik") + ", rp as (" + _REP.format(cols="year, side,", rows="sd") + """), m as (select draw, year, median(v) filter (where side = 'a') as ma, median(v) filter (where side = 'b') as mb from rp group by 1, 2), st as (select year, ma - mb as s from m where ma is not null and mb is not null)
 select st.year, round(any_value(o.obs), 9) as obs, round(quantile_cont(s, 0.025), 9) as lo, round(quantile_cont(s, 0.975), 9) as hi from st join (select year, median(v) filter (where side = 'a') - median(v) filter (where side = 'b') as obs from sd group by 1) o on o.year = st.year group by 1""")
def r2_median(spark: SparkSession, d: str) -> DataFrame:
    return B.cluster_boot_diff(sided(spark, d), "gross_margin", "cik", "side", "median", BOOTS, by=["year"]).where("lo is not null").select("year", *(R(c, 9).alias(c) for c in ("obs", "lo", "hi")))


@query("r3_extremes_vs_middle", DEC_S + """, rk as (select cik, year, net_margin as v, row_number() over (partition by year order by gross_margin, cik) rn, count(*) over (partition by year) n from dec), bn as (select *, greatest(1, least(5, ceil(rn::double / n * 5)))::int as bin from rk where n >= 5), sd as (select cik, v, case when bin in (1, 5) then 'a' when bin = 3 then 'b' end as side from bn where bin in (1, 3, 5)), """ + _mult("sd", "cik") + """,
 st as (select draw, sum(v * w) filter (where side = 'a') / sum(w) filter (where side = 'a') - sum(v * w) filter (where side = 'b') / sum(w) filter (where side = 'b') as s, coalesce(sum(w) filter (where side = 'a'), 0) na, coalesce(sum(w) filter (where side = 'b'), 0) nb from sd join mu on mu.grp = sd.cik group by 1)
 select (select round(avg(v) filter (where side = 'a') - avg(v) filter (where side = 'b'), 9) from sd) as obs, round(quantile_cont(s, 0.025), 9) as lo, round(quantile_cont(s, 0.975), 9) as hi from st where na >= 2 and nb >= 2""")
def r3(spark: SparkSession, d: str) -> DataFrame:
    x = P.qcut_within(dec_s(spark, d), "gross_margin", "year", ["cik"], 5, 1)
    return B.extremes_vs_middle(x, "bin", "net_margin", "cik", draws=BOOTS).select(*(R(c, 9).alias(c) for c in ("obs", "lo", "hi")))


@query("r4_multiplicities", _G + ", " + _mult("src", "cik", 3) + " select draw, grp, w from mu")
def r4(spark: SparkSession, d: str) -> DataFrame:
    return B.multiplicities(dec_s(spark, d), "cik", BOOTS, 3).select("draw", "grp", "w")


@query("r5_boot_ratio_of_means", DEC_S + ", src as (select cik, gross_margin as v, health_score as z from dec), " + _mult("src", "cik") + ", st as (select draw, sum(v * w) / sum(z * w) as s from src join mu on mu.grp = src.cik group by 1) select (select round(avg(v) / avg(z), 9) from src) as obs, round(quantile_cont(s, 0.025), 9) as lo, round(quantile_cont(s, 0.975), 9) as hi from st")
def r5(spark: SparkSession, d: str) -> DataFrame:
    x = dec_s(spark, d)
    return B.boot_ratio(x.select("cik", F.col("gross_margin").alias("v")), x.select("cik", F.col("health_score").alias("v")), "v", "cik", "mean", BOOTS).select(*(R(c, 9).alias(c) for c in ("obs", "lo", "hi")))


def _perm(rows: str, keep: str, draws: int = 5, seed: int = 0) -> str:
    """CTEs px and wk: columns `keep` of a CTE's rows (x, n, c), the draw, and y, where functions.draws.permuted takes x of 0..n-1 in cell c.
    A step of the recursion is all rounds; a point outside the range takes another one."""
    own = ", ".join([keep, "draw", "k", "n", "a", "b"])
    step = f"select {own}, y // b as i, y % b as j from wk where y is null or y >= n"
    step = step.replace("y // b", "coalesce(y, x) // b").replace("y % b", "coalesce(y, x) % b")
    for r in range(ROUNDS):
        read, write, size = ("i", "j", "b") if r % 2 else ("j", "i", "a")
        step = f"select {own}, i, j, xor(k, {_mix(f'({read} & {WORD})')}) as h from ({step})"
        step = f"select {own}, {read}, ({write} + {_mix(f'((h + {r + 1} * {STEP}) & {WORD})')}) % {size} as {write} from ({step})"
    base = int(mix(np.uint64([seed]))[0])
    return f"""px as (select {keep}, x, n, d as draw, {_mix(f"xor({_mix(f'xor({base}::bigint, d)')}, c & {WORD})")} as k, ceil(sqrt(n))::bigint as a, (n + ceil(sqrt(n))::bigint - 1) // ceil(sqrt(n))::bigint as b from {rows}, range(1, {draws + 1}) t(d)),
 wk as (select {own}, x, null::bigint as y from px union all select {own}, null::bigint, i * b + j from ({step}))"""


_BIJ = "gk as (select cik, row_number() over (order by cik) - 1 as x, count(*) over () as n, 0::bigint as c from (select distinct cik from fr)), " + _perm("gk", "cik") + ", bij as (select draw, wk.cik, gk.cik as partner from wk join gk on gk.x = wk.y where wk.y < wk.n)"


@query("r6_clustered_shuffle_by_year", DEC_S + ", fr as (select cik || '|' || year as id, cik, year, piotroski as lab from dec), " + _BIJ + """, ks as (select year, row_number() over (order by year) k from (select distinct year from fr)), fk as (select fr.*, k from fr join ks using (year)), cell as (select cik, k, count(*) n from fk group by 1, 2), src as (select cik as partner, k as s, lab, row_number() over (partition by cik, k order by id) - 1 as i from fk),
 rr as (select fk.*, draw, partner, (select arg_min(c.k, abs(c.k - fk.k) * 1000 + c.k) from cell c where c.cik = bij.partner) as s from fk join bij using (cik)), ri as (select rr.*, (row_number() over (partition by draw, partner, s order by id) - 1) % n as i from rr join cell c on c.cik = rr.partner and c.k = rr.s)
 select id, draw, src.lab as shuffled, s <> k as fell_back from ri join src using (partner, s, i)""")
def r6(spark: SparkSession, d: str) -> DataFrame:
    x = dec_s(spark, d).withColumn("id", F.concat_ws("|", "cik", "year"))
    return N.clustered_shuffle(x.select("id", "cik", "year", "piotroski"), "piotroski", "cik", "id", "year", draws=5).select("id", "draw", "shuffled", "fell_back")


@query("r6_clustered_shuffle", DEC_S + ", fr as (select cik || '|' || year as id, cik, year, piotroski as lab from dec), " + _BIJ + """, sz as (select cik, count(*) n from fr group by 1), src as (select cik as partner, lab, row_number() over (partition by cik order by id) - 1 as i from fr), rr as (select fr.id, draw, partner, (row_number() over (partition by draw, partner order by id) - 1) % n as i from fr join bij using (cik) join sz on sz.cik = bij.partner) select id, draw, src.lab as shuffled from rr join src using (partner, i)""")
def r6b(spark: SparkSession, d: str) -> DataFrame:
    x = dec_s(spark, d).withColumn("id", F.concat_ws("|", "cik", "year"))
    return N.clustered_shuffle(x.select("id", "cik", "year", "piotroski"), "piotroski", "cik", "id", draws=5).select("id", "draw", "shuffled")


def _cells(rows: str, by: str, key: str, lab: str, keep: str, draws: int = 5) -> str:
    """CTEs up to sh (keep..., draw, shuffled): the labels of a CTE's rows permuted inside the cells of `by`."""
    order = ", ".join(f"{c.strip()} nulls first" for c in f"{by}, {key}".split(","))
    return f"""ps as (select *, row_number() over (order by {order}) - 1 as pos from {rows}), pc as (select *, min(pos) over (partition by {by}) as c, count(*) over (partition by {by}) as n from ps), pd as (select *, c as first, pos - c as x from pc),
 {_perm("pd", keep + ", first", draws)}, sh as (select {", ".join("wk." + k.strip() for k in keep.split(","))}, draw, ps.{lab} as shuffled from wk join ps on ps.pos = wk.first + wk.y where wk.y < wk.n)"""


def _within(by: str) -> str:
    return DEC_S + ", fr as (select cik || '|' || year as id, cik, year, sector, piotroski as lab from dec), " + _cells("fr", by, "id", "lab", "id") + " select id, draw, shuffled from sh"


def _shuffle(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    x = dec_s(spark, d).withColumn("id", F.concat_ws("|", "cik", "year")).select("id", "cik", "year", "sector", "piotroski")
    return N.within_shuffle(x, "piotroski", by, "id", draws=5).select("id", "draw", "shuffled")


@query("r7_within_firm_shuffle", _within("cik"))
def r7(spark: SparkSession, d: str) -> DataFrame:
    return _shuffle(spark, d, ["cik"])


@query("r8_year_stratum_shuffle", _within("year, sector"))
def r8(spark: SparkSession, d: str) -> DataFrame:
    return _shuffle(spark, d, ["year", "sector"])


@query("r12_unit_shuffle", DEC_S + ", u as (select sector, cik, min(piotroski) lab from dec group by 1, 2), " + _cells("u", "sector", "cik", "lab", "sector, cik") + " select dec.cik, dec.year, draw, shuffled from sh join dec on dec.cik = sh.cik and dec.sector is not distinct from sh.sector")
def r12(spark: SparkSession, d: str) -> DataFrame:
    return N.unit_shuffle(dec_s(spark, d).select("cik", "year", "sector", "piotroski"), "piotroski", "cik", "sector", draws=5).select("cik", "year", "draw", "shuffled")


@query("r11_cell_mean_shuffle", DEC_S + ", fr as (select cik, year, gross_margin as lab from dec), " + _BIJ + """, ce as (select cik as partner, year, avg(lab) m from fr group by 1, 2), al as (select cik as partner, avg(lab) m from fr group by 1) select fr.cik, fr.year, draw, round(coalesce(ce.m, al.m), 12) as shuffled from fr join bij using (cik) join al using (partner) left join ce on ce.partner = bij.partner and ce.year = fr.year""")
def r11(spark: SparkSession, d: str) -> DataFrame:
    out = N.cell_mean_shuffle(dec_s(spark, d).select("cik", "year", "gross_margin"), "gross_margin", "cik", "year", draws=5)
    return out.select("cik", "year", "draw", R("shuffled", 12).alias("shuffled"))


def _spread_by_draw(spark: SparkSession, d: str, draws: int) -> tuple[DataFrame, DataFrame]:
    """The spread of net margin between low and high piotroski by sector: observed, and with labels shuffled within the year."""
    x = dec_s(spark, d).withColumn("id", F.concat_ws("|", "cik", "year")).select("id", "year", "sector", "piotroski", "net_margin")
    gap = lambda c: F.avg(F.when(F.col(c) <= 4, F.col("net_margin"))) - F.avg(F.when(F.col(c) > 4, F.col("net_margin")))
    obs = x.groupBy("sector").agg(gap("piotroski").alias("value"))
    null = N.within_shuffle(x, "piotroski", ["year"], "id", draws=draws).groupBy("sector", "draw").agg(gap("shuffled").alias("value"))
    return obs, null


_SPREAD = DEC_S + ", fr as (select cik || '|' || year as id, year, sector, piotroski as lab, net_margin from dec), " + _cells("fr", "year", "id", "lab", "id, sector, net_margin", DRAWS) + """,
 ob as (select sector, avg(net_margin) filter (where lab <= 4) - avg(net_margin) filter (where lab > 4) as value from fr group by 1), nu as (select sector, draw, avg(net_margin) filter (where shuffled <= 4) - avg(net_margin) filter (where shuffled > 4) as value from sh group by 1, 2)"""


@query("r13_placebo_table", _SPREAD + """ select sector, round(max(ob.value), 9) as observed, round(avg(nu.value), 9) as null_mean, round(stddev_samp(nu.value), 9) as null_sd, round(quantile_cont(abs(nu.value), 0.95), 9) as p95_abs, round(avg((abs(nu.value) >= abs(ob.value))::int), 9) as share_as_extreme from nu join ob using (sector) group by 1""")
def r13(spark: SparkSession, d: str) -> DataFrame:
    obs, null = _spread_by_draw(spark, d, DRAWS)
    return N.placebo_table(obs, null, ["sector"]).select("sector", *(R(c, 9).alias(c) for c in ("observed", "null_mean", "null_sd", "p95_abs", "share_as_extreme")))


@query("r10_family_chance", _SPREAD + """, t as (select sector, draw, value from nu union all select sector, 0, value from ob), c as (select t.sector, t.draw, avg(case when t.value >= 0 then (nu.value >= t.value)::int else (nu.value <= t.value)::int end) <= 0.05 as clear from t join nu on nu.sector = t.sector group by 1, 2), k as (select draw, sum(clear::int) k, count(*) n from c group by 1), o as (select k as oc, n from k where draw = 0)
 select any_value(n_cells) as n_cells, any_value(oc)::bigint as observed_clear, round(avg(k), 9) as expected, round(stddev_pop(k), 9) as sd, round(avg((k >= 1)::int), 9) as p_any, round(avg((k >= oc)::int), 9) as p_at_least_observed from (select k.k, o.oc, o.n as n_cells from k, o where draw > 0)""")
def r10(spark: SparkSession, d: str) -> DataFrame:
    obs, null = _spread_by_draw(spark, d, DRAWS)
    out = N.family_chance(obs.withColumnRenamed("sector", "cell"), null.select(F.col("sector").alias("cell"), F.lit("year").alias("null_name"), "draw", "value"), 0.05)
    return out.select("n_cells", "observed_clear", *(R(c, 9).alias(c) for c in ("expected", "sd", "p_any", "p_at_least_observed")))


_CASES = V.with_views("panel_c") + """, t as (select cik, qi, sector, least(3, ((row_number() over (partition by qi order by revenue, cik) - 1) * 3) // count(*) over (partition by qi) + 1)::int as tercile, n_orders from panel_c),
 ca as (select cik || '|' || qi as case_id, qi, tercile from t where n_orders >= 3), co as (select cik as control_id, qi, tercile, row_number() over (partition by qi, tercile order by cik) - 1 as pos, count(*) over (partition by qi, tercile) as n from t where n_orders = 1), sz as (select qi, tercile, max(n) n from co group by 1, 2)"""


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = P.tercile(V.panel_c(spark, d), "revenue", ["qi"], ["cik"])
    return t.where("n_orders >= 3").select(F.concat_ws("|", "cik", "qi").alias("case_id"), "qi", "tercile"), t.where("n_orders = 1").select(F.col("cik").alias("control_id"), "qi", "tercile")


_PAIRS = _CASES + f""", d0 as (select ca.*, n, {_h("'0'", "'0'", 'case_id')} % n as p0 from ca join sz using (qi, tercile)), d1 as (select *, case when n > 1 then {_h("'0'", "'1'", 'case_id')} % (n - 1) end as q1 from d0), e1 as (select *, case when q1 >= p0 then q1 + 1 else q1 end as p1 from d1), d2 as (select *, case when n > 2 then {_h("'0'", "'2'", 'case_id')} % (n - 2) end as q2 from e1),
 e2 as (select *, case when q2 >= least(p0, p1) then q2 + 1 else q2 end as h2 from d2), e3 as (select *, case when h2 >= greatest(p0, p1) then h2 + 1 else h2 end as p2 from e2), l as (select case_id, qi, tercile, unnest([p0, p1, p2]) as pos from e3), pairs as (select case_id, control_id from l join co using (qi, tercile, pos))"""


@query("j16_matched_controls", _PAIRS + " select case_id, control_id from pairs")
def j16(spark: SparkSession, d: str) -> DataFrame:
    return M.matched_controls(*_cases(spark, d), ["qi", "tercile"])


@query("j16_unmatched_cases", _CASES + " select case_id from ca where (qi, tercile) not in (select (qi, tercile) from sz)")
def j16b(spark: SparkSession, d: str) -> DataFrame:
    return M.unmatched(*_cases(spark, d), ["qi", "tercile"]).select("case_id")


@query("j17_trajectories", V.with_views("panel_s") + """, an as (select cik || '' as aid, cik, max(qi) as qi from panel_s group by 1, 2), g as (select an.*, k::int as k, an.qi + k as q from an, range(-8, 0) t(k)), j as (select g.aid, g.k, p.gross_margin, p.net_margin from g left join panel_s p on p.cik = g.cik and p.qi = g.q), l as (select aid, k, 'gross_margin' as metric, gross_margin as value from j union all select aid, k, 'net_margin', net_margin from j)
 select aid, k, metric, round(value - first_value(value) over (partition by aid, metric order by k), 9) as change from l""")
def j17(spark: SparkSession, d: str) -> DataFrame:
    p = V.panel_s(spark, d)
    an = p.groupBy("cik").agg(F.max("qi").alias("qi")).withColumn("aid", F.col("cik").cast("string"))
    return M.trajectories(an, p, ["gross_margin", "net_margin"]).select("aid", "k", "metric", R("change", 9).alias("change"))


@query("j23_nearest_controls", DEC_S + """, t as (select cik || '|' || year as id, year, sector, revenue from dec where piotroski < 3), c as (select cik || '|' || year as id, year, sector, revenue from dec where piotroski >= 5) select t.id as treated_id, arg_min(c.id, {'a': abs(c.revenue - t.revenue), 'b': c.revenue}) as control_id from t join c using (year, sector) group by 1""")
def j23(spark: SparkSession, d: str) -> DataFrame:
    x = dec_s(spark, d).withColumn("id", F.concat_ws("|", "cik", "year"))
    t, c = x.where("piotroski < 3").withColumnRenamed("id", "treated_id"), x.where("piotroski >= 5").withColumnRenamed("id", "control_id")
    return M.nearest_controls(t, c, ["year", "sector"], "revenue").where("control_id is not null")




def _did(seed: int = 0) -> str:
    """CTEs up to did: the match and the draws under a seed."""
    return _PAIRS.replace("md5('0' ||", f"md5('{seed}' ||") + """, an as (select 'a' || case_id as aid, split_part(case_id, '|', 1)::bigint as cik, qi, 'a' as side from ca union all select 'b|' || case_id || '|' || control_id, control_id, qi, 'b' from pairs join ca using (case_id)), g as (select an.*, k::int as k, qi + k as q from an, range(-4, 0) t(k)),
 jj as (select aid, g.cik, side, k, p.revenue, p.n_orders from g left join panel_c p on p.cik = g.cik and p.qi = g.q), lg as (select aid, cik, side, k, 'revenue' as metric, revenue::double as value from jj union all select aid, cik, side, k, 'n_orders', n_orders::double from jj), ch as (select *, value - first_value(value) over (partition by aid, metric order by k) as v from lg), sd as (select * from ch where k > -4 and v is not null), """ + _mult("sd", "cik", seed, CELLS) + """,
 st as (select metric, k, draw, sum(v * w) filter (where side = 'a') / sum(w) filter (where side = 'a') - sum(v * w) filter (where side = 'b') / sum(w) filter (where side = 'b') as s, coalesce(sum(w) filter (where side = 'a'), 0) na, coalesce(sum(w) filter (where side = 'b'), 0) nb from sd join mu on mu.grp = sd.cik group by 1, 2, 3), e as (select metric, k, quantile_cont(s, 0.025) lo, quantile_cont(s, 0.975) hi from st where na >= 1 and nb >= 1 group by 1, 2),
 o as (select metric, k, avg(v) filter (where side = 'a') - avg(v) filter (where side = 'b') as obs, count(*) filter (where side = 'a') as n_a, count(*) filter (where side = 'b') as n_b, avg((v = 0)::int) filter (where side = 'a') as zs from sd group by 1, 2), did as (select o.metric, o.k, round(obs, 6) as obs, round(lo, 6) as lo, round(hi, 6) as hi, n_a, n_b, round(zs, 6) as zero_share, round(lo, 6) > 0 or round(hi, 6) < 0 as excludes_zero from o left join e on e.metric = o.metric and e.k = o.k)"""


_DID = _did()


@query("r14_did_table", _DID + " select * from did")
def r14(spark: SparkSession, d: str) -> DataFrame:
    """Cases against their matched controls: change of each metric at each quarter before the anchor, all cells from one set of draws."""
    cases, controls = _cases(spark, d)
    pairs = M.matched_controls(cases, controls, ["qi", "tercile"])
    a = cases.select(F.concat(F.lit("a"), "case_id").alias("aid"), F.split("case_id", r"\|")[0].cast("long").alias("cik"), "qi")
    b = pairs.join(cases, "case_id").select(F.concat_ws("|", F.lit("b"), "case_id", "control_id").alias("aid"), F.col("control_id").alias("cik"), "qi")
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    long = M.trajectories(both, V.panel_c(spark, d), ["revenue", "n_orders"], -4, -1).join(both.select("aid", "cik", "side"), "aid")
    out = B.cluster_boot_diff(long.where("k > -4"), "change", "cik", "side", "mean", CELLS, by=["metric", "k"])
    zero = long.where("k > -4 and side = 'a' and change is not null").groupBy("metric", "k").agg(R(F.avg((F.col("change") == 0).cast("double")), 6).alias("zero_share"))
    out = out.select("metric", "k", *(R(c, 6).alias(c) for c in ("obs", "lo", "hi")), "n_a", "n_b").join(zero, ["metric", "k"], "left")
    return out.withColumn("excludes_zero", F.expr("lo > 0 or hi < 0"))


@query("r14_first_significant", _DID + " select metric, min(k) filter (where excludes_zero) as k from did group by 1")
def r14_first(spark: SparkSession, d: str) -> DataFrame:
    """The earliest quarter whose interval excludes zero, null if none does."""
    return r14(spark, d).groupBy("metric").agg(F.min(F.when(F.col("excludes_zero"), F.col("k"))).alias("k"))


@query("r16_removal_bound", V.with_views("panel_s") + f""", v as (select max(as_of_date) v from panel_s), g as (select cik, max(as_of_date) lr, (max(as_of_date) + interval 24 month)::date <= (select v from v) as ex from panel_s group by 1), e as (select cik, d as draw, row_number() over (partition by d order by {_h("'0'", 'd', 'cik')}, cik) rn, count(*) over (partition by d) n from g, range(1, {DRAWS + 1}) t(d) where ex),
 x as (select draw, cik from e where rn > floor(0.25 * n)), r as (select d as draw, (count(*) filter (where ex and cik in (select cik from x where x.draw = d)))::double / (count(*) filter (where not ex) + count(*) filter (where ex and cik in (select cik from x where x.draw = d))) as rate from g, range(1, {DRAWS + 1}) t(d) group by 1) select draw, round(rate, 9) as rate from r""")
def r16(spark: SparkSession, d: str) -> DataFrame:
    """The exit rate when a quarter of the exiting firms is dropped at random, by draw."""
    f = P.exit_frame(V.panel_s(spark, d)).select("cik", "exit").withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(DRAWS).cast("long"))))
    w = Window.partitionBy("draw", "exit")
    f = f.withColumn("rn", F.row_number().over(w.orderBy(draw(F.lit(0), "draw", "cik"), "cik"))).withColumn("n", F.count("*").over(w))
    return f.where("not exit or rn > floor(0.25 * n)").groupBy("draw").agg(R(F.avg(F.col("exit").cast("double")), 9).alias("rate"))


@query("r19_z_trend", DEC_S + """, x as (select d.cik, d.year, d.altman_z - p.altman_z as dz, d.net_margin < 0.08 as thin from dec d left join panel_s p on p.cik = d.cik and p.qi = d.qi - 3) select thin, count(*) as n, count(dz) as classified, round(avg((dz > 0)::int) filter (where dz is not null), 9) as rising from x group by 1""")
def r19(spark: SparkSession, d: str) -> DataFrame:
    before = V.panel_s(spark, d).select("cik", (F.col("qi") + 3).alias("qi"), F.col("altman_z").alias("z0"))
    x = dec_s(spark, d).join(before, ["cik", "qi"], "left").withColumn("dz", F.col("altman_z") - F.col("z0"))
    return x.groupBy((F.col("net_margin") < 0.08).alias("thin")).agg(F.count("*").alias("n"), F.count("dz").alias("classified"), R(F.avg((F.col("dz") > 0).cast("double")), 9).alias("rising"))


@query("r20_random_halves", DEC_S + f""", h as (select d as draw, avg(gross_margin) filter (where {_h("'0'", 'd', 'cik')} % 2 = 0) - avg(gross_margin) filter (where {_h("'0'", 'd', 'cik')} % 2 = 1) as gap from dec, range(1, {DRAWS + 1}) t(d) group by 1) select draw, round(gap, 9) as gap from h""")
def r20(spark: SparkSession, d: str) -> DataFrame:
    x = dec_s(spark, d).select("cik", "gross_margin").withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(DRAWS).cast("long")))).withColumn("half", draw(F.lit(0), "draw", "cik") % 2)
    of = lambda k: F.avg(F.when(F.col("half") == k, F.col("gross_margin")))
    return x.groupBy("draw").agg(R(of(0) - of(1), 9).alias("gap"))


@query("r21_stratified_reaverage", _SIDED.rstrip(", ") + """, c as (select year, avg(v) filter (where side = 'a') ma, avg(v) filter (where side = 'b') mb, count(*) filter (where side = 'a') na, count(*) filter (where side = 'b') nb from sd group by 1) select round(sum((ma - mb) * na) / sum(na), 9) as gap, count(*) as cells from c where na > 0 and nb > 0""")
def r21(spark: SparkSession, d: str) -> DataFrame:
    of = lambda s: F.when(F.col("side") == s, F.col("gross_margin"))
    c = sided(spark, d).groupBy("year").agg(F.avg(of("a")).alias("ma"), F.avg(of("b")).alias("mb"), F.count(of("a")).alias("na"), F.count(of("b")).alias("nb")).where("na > 0 and nb > 0")
    return c.agg(R(F.sum((F.col("ma") - F.col("mb")) * F.col("na")) / F.sum("na"), 9).alias("gap"), F.count("*").alias("cells"))


@query("r23_date_placebo", V.with_views("bars") + f""", s as (select ticker, min(date) a, max(date) z from bars group by 1), p as (select ticker, d as draw, a + ({_h("'0'", 'd', 'ticker')} % ((z - a) + 1))::int as day from s, range(1, 11) t(d)) select ticker, draw, day from p""")
def r23(spark: SparkSession, d: str) -> DataFrame:
    """Random dates inside each ticker's own coverage."""
    from ..operators.asof import series

    s = series(V.bars(spark, d)).withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))))
    span = F.datediff("last_bar", "first_bar") + 1
    return s.withColumn("k", (draw(F.lit(0), "draw", "ticker") % span).cast("int")).select("ticker", "draw", F.expr("date_add(first_bar, k)").alias("day"))


_LADDER = DEC_S + """, x as (select cik, year, altman_z as v, net_margin as o from dec where altman_z is not null), y as (select *, avg(v) over w2 as pm, count(*) over w2 as pn, v - avg(v) over w1 as dm, (rank() over (partition by cik order by v) + (count(*) over (partition by cik, v) - 1) / 2) / count(*) over w1 as rk, count(*) over w1 as n from x window w1 as (partition by cik), w2 as (partition by cik order by year rows between unbounded preceding and 1 preceding)),
 l as (select 'raw' as sorted_on, cik, year, o, v from y union all select 'prior mean', cik, year, o, pm from y where pn >= 2 union all select 'within-firm rank', cik, year, o, rk from y where n >= 5 union all select 'within-firm demeaned', cik, year, o, dm from y where n >= 5), r as (select *, round(v, 9) v9 from l), b as (select *, row_number() over (partition by sorted_on, year order by v9, cik) rn, count(*) over (partition by sorted_on, year) nn from r), q as (select *, greatest(1, least(3, ceil(rn::double / nn * 3)))::int as bin from b where nn >= 3)"""


def ladder(spark: SparkSession, d: str) -> DataFrame:
    """One column sorted four ways (sorted_on, cik, year, o, v)."""
    x = dec_s(spark, d).where("altman_z is not null").select("cik", "year", F.col("altman_z").alias("v"), F.col("net_margin").alias("o"))
    w, prior = Window.partitionBy("cik"), Window.partitionBy("cik").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(w)
    rank = (F.rank().over(w.orderBy("v")) + (F.count("*").over(Window.partitionBy("cik", "v")) - 1) / 2) / n
    y = x.select("*", F.avg("v").over(prior).alias("pm"), F.count("v").over(prior).alias("pn"), (F.col("v") - F.avg("v").over(w)).alias("dm"), rank.alias("rk"), n.alias("n"))
    four = F.array(*(F.struct(F.lit(k).alias("sorted_on"), F.when(c, F.col(v)).alias("v")) for k, v, c in (("raw", "v", F.lit(True)), ("prior mean", "pm", F.expr("pn >= 2")), ("within-firm rank", "rk", F.expr("n >= 5")), ("within-firm demeaned", "dm", F.expr("n >= 5")))))
    return y.select("cik", "year", "o", F.explode(four).alias("s")).select("cik", "year", "o", "s.sorted_on", R("s.v", 9).alias("v")).where("v is not null")


@query("w3_decomposition_ladder", _LADDER + " select sorted_on, count(*) as n, count(distinct cik) as firms, round(avg(o) filter (where bin = 3) - avg(o) filter (where bin = 1), 9) as gap from q group by 1")
def w3(spark: SparkSession, d: str) -> DataFrame:
    q = P.qcut_within(ladder(spark, d), "v", ["sorted_on", "year"], ["cik"], 3, 1).where("bin is not null")
    side = F.when(F.col("bin") == 3, "a").when(F.col("bin") == 1, "b")
    boot = B.cluster_boot_diff(q.withColumn("side", side), "o", "cik", "side", "mean", CELLS, by=["sorted_on"])
    return q.groupBy("sorted_on").agg(F.count("*").alias("n"), F.count_distinct("cik").alias("firms")).join(boot.select("sorted_on", R("obs", 9).alias("gap")), "sorted_on")


_XY = DEC_S + ", x as (select net_margin as y, operating_margin as a, gross_margin as b from dec), c as (select corr(y, a) ya, corr(y, b) yb, corr(a, b) ab from x), r as (select ya * ya as ra, yb * yb as rb, (ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab) as rab from c)"


@query("v15_shapley", _XY + " select 'a' as block, round(ra, 8) as alone, round((ra + rab - rb) / 2, 8) as shapley from r union all select 'b', round(rb, 8), round((rb + rab - ra) / 2, 8) from r")
def v15(spark: SparkSession, d: str) -> DataFrame:
    out = VA.shapley_table(dec_s(spark, d), "net_margin", {"a": ["operating_margin"], "b": ["gross_margin"]})
    return out.select("block", R("alone", 8).alias("alone"), R("shapley", 8).alias("shapley"))


@query("a44_log_variance_split", V.with_views("panel_c") + ", x as (select ln(revenue) as y, ln(n_orders) as a, year(as_of_date) as yr from panel_c where revenue > 0) select round(covar_samp(a, y) / var_samp(y), 8) as pooled, round((select covar_samp(a2, y2) / var_samp(y2) from (select a - avg(a) over (partition by yr) a2, y - avg(y) over (partition by yr) y2 from x)), 8) as year_demeaned from x")
def a44(spark: SparkSession, d: str) -> DataFrame:
    x = V.panel_c(spark, d).where("revenue > 0").select(F.ln("revenue").alias("y"), F.ln("n_orders").alias("a"), F.year("as_of_date").alias("yr"))
    w = Window.partitionBy("yr")
    x = x.select("y", "a", (F.col("a") - F.avg("a").over(w)).alias("a2"), (F.col("y") - F.avg("y").over(w)).alias("y2"))
    return x.agg(R(F.covar_samp("a", "y") / F.var_samp("y"), 8).alias("pooled"), R(F.covar_samp("a2", "y2") / F.var_samp("y2"), 8).alias("year_demeaned"))
