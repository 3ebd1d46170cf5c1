"""Ranks and quantiles of large and tied cohorts against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.operators import panel as P
from panelyard.operators import ranks as R
from panelyard.operators import variance as VA


def _windows(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(99, None), (99, float("nan"))]
    for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 10, 11, 50, 999, 30_000]):
        v = rng.normal(size=n).round(3) if k % 2 else rng.integers(0, 5, n).astype(float)
        rows += [(k or None, float(x)) for x in v]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975, 1.0]
    got = {r.k: r.q for r in R.quantiles(df, "v", ["k"], probs).collect()}
    want = {r.k: r.q for r in df.where("k is null or k <> 99").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-15) for k in want)
    assert R.quantiles(df.limit(0), "v", ["k"], [0.5]).count() == 0
    assert R.quantiles(df, "v", [], [0.5]).first().q == [pytest.approx(float(np.median([v for _, v in rows if v is not None and v == v])))]


def test_quantile_brackets_hold_on_a_cohort_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "ACCURACY", 50)  # a coarse sketch: brackets with many rows, and rows on both sides
    df = spark.range(20_000).select(F.lit("all").alias("c"), (F.pow(F.pmod(F.col("id") * 7919, F.lit(20_011)) / 1000, F.lit(3)).cast("long") / 7).alias("v"))
    q = R.quantiles(df, "v", ["c"], [0.01, 0.5, 0.99])
    assert q.first().q == pytest.approx(df.agg(F.percentile("v", F.array(*map(F.lit, (0.01, 0.5, 0.99))))).first()[0])


def test_ranks_of_one_cohort_of_all_rows(spark):
    rows = [("all" if k % 50 else None, (k * 37) % 101, k) for k in range(4000)]
    df = spark.createDataFrame(rows, "c string, v int, id int").repartition(6)
    out = R.ranked(df, ["c"], ["v", "id"])
    assert all("_range" in w for w in _windows(out))
    got = {r.id: (r._rank, r._n) for r in out.collect()}
    for c in ("all", None):
        own = sorted((r[1], r[2]) for r in rows if r[0] == c)
        assert {i: (k + 1, len(own)) for k, (_, i) in enumerate(own)} == {r[2]: got[r[2]] for r in rows if r[0] == c}
    tied = {r.id: r._rank for r in R.average_ranked(df, ["c"], "v").collect()}
    place = {}
    for k, (v, i) in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == "all")):
        place.setdefault(v, []).append(k + 1)
    assert all(tied[r[2]] == np.mean(place[r[1]]) for r in rows if r[0] == "all")


def test_bins_and_spearman_hold_no_cohort_in_a_window(spark):
    df = spark.range(1000).select(F.lit("x").alias("c"), F.col("id"), (F.col("id") * 31 % 997).cast("double").alias("a"), (F.col("id") % 10).cast("double").alias("b"))
    for out in (P.qcut_within(df, "a", "c", ["id"]), P.tercile(df, "a", ["c"], ["id"]), P.rank_terciles(df, "a", ["c"], ["id"]), P.market_adjust(df, ["a", "b"], ["c"]), VA.spearman(df, "a", "b", ["c"])):
        assert not [w for w in _windows(out) if "_range" not in w and "kind" not in w], out.columns
    sizes = {r["bin"]: r["count"] for r in P.qcut_within(df, "a", "c", ["id"]).groupBy("bin").count().collect()}
    assert sizes == {k: 200 for k in range(1, 6)}
    from_numpy = np.corrcoef(*[np.argsort(np.argsort(x, kind="stable")) for x in ([k * 31 % 997 for k in range(997)], [k * 31 % 997 for k in range(997)])])[0, 1]
    assert VA.spearman(df.limit(997), "a", "a", ["c"]).first().rho == pytest.approx(from_numpy)
