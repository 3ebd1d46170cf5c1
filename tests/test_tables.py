"""Helpers of the study tables against plain computations, and the tables' oracles on the smallest data."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.functions.calendar import naive_date
from panelyard.operators import panel as P
from panelyard.operators import resample as B
from panelyard.plans import table_queries
from panelyard.sources import views as V

from .test_registry import _plain

SF = "/root/testdata/sf0.001"


def test_rank_terciles_match_cut_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{n}", k, float(rng.integers(0, 5))) for n in (1, 2, 3, 4, 5, 7, 9, 11, 50) for k in range(n)]
    got = {(r.c, r.i): r.tercile for r in P.rank_terciles(spark.createDataFrame(rows, "c string, i int, v double"), "v", ["c"], ["i"]).collect()}
    frame = pd.DataFrame(rows, columns=["c", "i", "v"]).sort_values(["c", "v", "i"])
    for c, g in frame.groupby("c"):
        want = pd.qcut(np.arange(1, len(g) + 1), 3, labels=[1, 2, 3]).astype(int) if len(g) >= 3 else [2] * len(g)
        assert [got[c, i] for i in g.i] == list(want)


def test_naive_dates_do_not_depend_on_the_time_zone(spark):
    texts = ["2020-03-31T23:59:59Z", "2020-03-31 00:00:01+00:00", "2020-03-31T12:00:00.123Z", "2020-02-30T00:00:00Z", "n/a", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Pacific/Auckland", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [str(r[0]) for r in df.select(naive_date(F.col("t")).cast("string")).collect()]
            assert got == ["2020-03-31"] * 3 + ["None"] * 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def _frame(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{g:02d}", float(np.round(rng.normal(), 2)), "ab"[g % 2], int(k % 2)) for g in range(23) for k in range(int(rng.integers(1, 6)))]
    return rows, spark.createDataFrame(rows, "g string, v double, side string, cell int")


def test_groups_are_numbered_in_order(spark):
    rows, df = _frame(spark)
    got = {r.grp: (r.idx, r.n) for r in B.indexed(df.repartition(5), "g").collect()}
    names = sorted({r[0] for r in rows})
    assert got == {g: (i, len(names)) for i, g in enumerate(names)}
    assert B.indexed(df.limit(0), "g").count() == 0


def _by_draw(rows, m, pick=lambda r: True):
    out = {}
    for draw in sorted({d for d, _ in m}):
        out[draw] = np.array([r[1] for r in rows if pick(r) for _ in range(m.get((draw, r[0]), 0))])
    return out


@pytest.mark.parametrize("held", [1 << 22, 30])
def test_bootstraps_match_repeated_rows(spark, monkeypatch, held):
    monkeypatch.setattr(B, "MOST_HELD", held)
    rows, df = _frame(spark)
    m = {(r.draw, r.grp): r.w for r in B.multiplicities(df, "g", 60, 4).collect()}
    draws = _by_draw(rows, m)
    for stat, f in (("mean", np.mean), ("median", np.median), ("rate", lambda v: (v > 0).mean())):
        source = rows if stat != "rate" else [(g, float(v > 0), s, c) for g, v, s, c in rows]
        d = df if stat != "rate" else df.withColumn("v", (F.col("v") > 0).cast("double"))
        r = B.cluster_bootstrap(d, "v", "g", stat, 60, 4).first()
        want = [f(v) for v in _by_draw(source, m).values()]
        assert (r.obs, r.lo, r.hi) == pytest.approx((f(np.array([x[1] for x in source])), np.quantile(want, 0.025), np.quantile(want, 0.975)))
    r = B.custom_bootstrap(df, "v", "g", lambda v: float(np.percentile(v, 90)), 60, 4).first()
    want = [np.percentile(v, 90) for v in draws.values()]
    assert (r.lo, r.hi) == pytest.approx((np.quantile(want, 0.025), np.quantile(want, 0.975)))
    for stat, f in (("mean", np.mean), ("median", np.median)):
        got = {r.cell: r for r in B.cluster_boot_diff(df, "v", "g", "side", stat, 60, 4, by=["cell"]).collect()}
        for cell in (0, 1):
            a, b = (_by_draw(rows, m, lambda r, s=s: r[2] == s and r[3] == cell) for s in "ab")
            want = [f(a[k]) - f(b[k]) for k in a if len(a[k]) and len(b[k])]
            assert (got[cell].lo, got[cell].hi, got[cell].share_le_0) == pytest.approx((np.quantile(want, 0.025), np.quantile(want, 0.975), np.mean(np.array(want) <= 0)))


def test_named_gaps_leave_something_out(spark):
    assert 0 < V.vendor_bars(spark, SF).count() < V.bars(spark, SF).count()
    assert 0 < V.sparse_bench(spark, SF).count() < V.bench(spark, SF).count()


@pytest.mark.parametrize("name", ["a10_base_rates", "a33_last_row_lag", "r18_gaps_by_anchor", "v12_valuation_on_one_basis", "v13_passport", "v16b_placebo_within_firm", "j19_revisions_of_known_periods", "a38_returns_by_reading"])
def test_tables_against_their_oracles(spark, name):
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    fn, sql = table_queries.Q[name]
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    df = fn(spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(map(_plain, r)) for r in want.fetchall())
