"""Splitting trees, bracketed medians and keyed permutations against plain counts."""

from collections import Counter, defaultdict
from math import comb, factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.functions import draws as D
from panelyard.operators import nulls as NU
from panelyard.operators import resample as B
from panelyard.sources.tables import numbered


@pytest.mark.parametrize("groups", [1, 2, 3, 17, 64, 1000])
def test_ranges_of_the_tree_agree_and_every_draw_takes_as_many_as_there_are(groups):
    draws = np.arange(1, 41)
    whole = D.multiplicities_of(0, groups, groups, draws, 5)
    assert (whole.sum(axis=0) == groups).all()
    for width in (1, 7, 300):
        parts = [D.multiplicities_of(a, min(a + width, groups), groups, draws, 5) for a in range(0, groups, width)]
        assert (np.concatenate(parts) == whole).all()
    assert (D.multiplicities_of(0, groups, groups, draws[10:], 5) == whole[:, 10:]).all()
    if groups > 3:
        assert (D.multiplicities_of(0, groups, groups, draws, 6) != whole).any()


def test_multiplicities_are_binomial():
    """Of 6 groups, 30,000 draws: counts of one group, and of two together, against their binomial shares."""
    w = D.multiplicities_of(0, 6, 6, np.arange(30_000), 11)
    for got, p in ((w[0], 1 / 6), (w[4], 1 / 6), (w[1] + w[2], 1 / 3)):
        want = np.array([comb(6, k) * p**k * (1 - p) ** (6 - k) for k in range(7)]) * 30_000
        seen = np.bincount(got, minlength=7)
        few = want < 5
        chi = ((seen - want) ** 2 / want)[~few].sum() + (seen[few].sum() - want[few].sum()) ** 2 / max(want[few].sum(), 1)
        assert chi < 25, (chi, seen, want)
    assert abs(np.corrcoef(w[0], w[1])[0, 1] + 1 / 5) < 0.02  # a multinomial's groups compete


def test_fair_coins():
    n = np.array([0, 1, 31, 32, 33, 64, 65, 10_000] * 500)
    got = D.ones(D.mix(np.arange(len(n), dtype=np.uint64)), n)
    assert (got <= n).all() and (got[n == 0] == 0).all()
    big = got[n == 10_000]
    assert abs(big.mean() - 5000) < 10 and abs(big.std() - 50) < 5


def test_permutation_of_every_size():
    for n in [*range(1, 200), 1023, 1024, 1025, 4097]:
        to = D.permuted(np.arange(n), np.full(n, n), D.key(3, np.full(n, 7)))
        assert sorted(to) == list(range(n)), n


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_permutations_are_even(n):
    times = 40_000
    to = D.permuted(np.tile(np.arange(n), times), np.full(n * times, n), D.key(1, np.repeat(np.arange(times), n))).reshape(times, n)
    seen, want = Counter(map(tuple, to)), times / factorial(n)
    assert len(seen) == factorial(n)
    assert sum((v - want) ** 2 / want for v in seen.values()) < factorial(n) + 5 * factorial(n) ** 0.5 + 10


def _median_rows():
    rng = np.random.default_rng(9)
    # one cell holds nearly all rows, many of them tied; one group holds a third of all
    rows = [("big", int(g), float(v)) for g, v in zip(np.where(rng.random(4000) < 0.33, 0, rng.integers(0, 90, 4000)), rng.normal(size=4000).round(2), strict=True)]
    return rows + [("one", 3, 5.0), ("two", 3, 1.0), ("two", 4, 2.0), (None, 8, 7.0)]


@pytest.mark.parametrize(("held", "level"), [(1 << 22, 6), (1 << 8, 6), (1 << 8, 2)])
def test_bracketed_medians_are_exact(spark, monkeypatch, held, level):
    monkeypatch.setattr(B, "MOST_HELD", held)
    monkeypatch.setattr(B, "LEVEL", level)
    rows = _median_rows()
    df = B.durable(spark.createDataFrame(rows, "cell string, grp int, v double"), "test")
    own = B.indexed(df, "grp")
    got = {(r.cell, r.draw): r.m for r in B._medians(B._collapsed(df, ["cell"]), own, ["cell"], 25, 2).collect()}
    m = {(r.draw, r.grp): r.w for r in B.multiplicities(df, "grp", 25, 2).collect()}
    want = {}
    for draw in range(1, 26):
        held_rows = defaultdict(list)
        for cell, g, v in rows:
            held_rows[cell] += [v] * m.get((draw, g), 0)
        want |= {(cell, draw): float(np.median(v)) for cell, v in held_rows.items() if v}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_no_row_per_draw_is_shuffled(spark):
    """Exchanges under a bootstrap carry rows, cells and arrays, never a draw beside a group or a value."""
    df = spark.createDataFrame([(f"g{k % 50}", float(k)) for k in range(500)], "g string, v double")
    plan = B.multiplicities(df, "g", 100)._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in top and "draw" not in plan[plan.index("MapInArrow") + 200 :]


def test_rows_are_numbered_across_ranges(spark):
    df = spark.createDataFrame([(None if k % 11 == 0 else (k * 7919) % 500, k) for k in range(3000)], "a int, b int").repartition(9)
    got = sorted((r.pos, r.a, r.b) for r in numbered(df, ["a", "b"], total="n").where("n = 3000").collect())
    want = sorted(((None if k % 11 == 0 else (k * 7919) % 500, k) for k in range(3000)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [g[1:] for g in got] == want and [g[0] for g in got] == list(range(3000))


def test_shuffle_of_one_cell_of_all_rows_is_not_in_one_task(spark):
    df = spark.range(4000).select(F.col("id"), F.lit("all").alias("cell"), (F.col("id") * 3).alias("label"))
    out = NU.within_shuffle(df, "label", ["cell"], "id", draws=3)
    windows = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x]
    assert all("_range" in x and "draw" not in x for x in windows)  # a row a range, never the rows
    for draw in (1, 2, 3):
        rows = out.where(F.col("draw") == draw).collect()
        assert sorted(r.shuffled for r in rows) == [3 * k for k in range(4000)] and sum(r.shuffled == r.label for r in rows) < 20


@pytest.mark.parametrize(("held", "level"), [(1 << 22, 6), (1 << 8, 2)])
def test_quantiles_and_sums_of_draws_match_a_function_of_all_rows(spark, monkeypatch, held, level):
    monkeypatch.setattr(B, "MOST_HELD", held)
    monkeypatch.setattr(B, "LEVEL", level)
    df = spark.createDataFrame([(g, v) for c, g, v in _median_rows() if c == "big"][:900], "grp int, v double")
    plain = lambda f: tuple(B.custom_bootstrap(df, "v", "grp", f, 30, 5).first())
    for prob in (0.9, 0.37):
        assert tuple(B.cluster_bootstrap(df, "v", "grp", "quantile", 30, 5, prob=prob).first())[:3] == pytest.approx(plain(lambda v, p=prob: np.quantile(v, p)))
    inner = F.col("v").between(-1, 1)
    trimmed = B.additive_bootstrap(df, {"s": F.when(inner, F.col("v")), "n": inner.cast("int")}, "grp", F.try_divide(F.col("s"), F.col("n")), 30, 5)
    assert tuple(trimmed.first()) == pytest.approx(plain(lambda v: v[(v >= -1) & (v <= 1)].mean()))
