"""Bars, as-of lookups, paths and event time on the hand-made series."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelyard.operators import asof as A
from panelyard.operators import returns as T
from panelyard.operators import survival as S
from panelyard.sources import readers as I


def business_days(n, start=dt.date(2021, 1, 4)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


DAYS = business_days(420)
SERIES = {"SPY": [100.0] * 420, "RAMP": [100.0 + i for i in range(420)], "SINK": [100 * 0.99**i for i in range(420)], "TINY": [50.0, 51.0, 52.0]}


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(t, d, c, 1000) for t, cs in SERIES.items() for d, c in zip(DAYS, cs)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume long").cache()


@pytest.fixture(scope="module")
def bench(bars):
    return bars.where("ticker = 'SPY'").select("date", "close")


def probes(spark, rows):
    return spark.createDataFrame(rows, "ticker string, day date")


@pytest.mark.parametrize("day, stale, want", [(DAYS[4], 14, 104.0), (dt.date(2021, 1, 9), 14, 104.0), (DAYS[-1] + dt.timedelta(60), 14, None), (DAYS[-1] + dt.timedelta(60), 90, 519.0), (dt.date(2021, 1, 9), 0, None), (dt.date(2020, 1, 1), 14, None)])
def test_close_at(spark, bars, day, stale, want):
    assert A.close_at(bars, probes(spark, [("RAMP", day)]), stale).first().px == want


@pytest.mark.parametrize("from_pages", [False, True])
def test_sides(spark, bars, from_pages):
    pos = A.positioned(bars)
    got = {}
    for side in ("<=", "<", ">="):
        p = probes(spark, [("RAMP", DAYS[300]), ("RAMP", dt.date(2021, 1, 9)), ("RAMP", DAYS[-1] + dt.timedelta(400)), ("RAMP", dt.date(2020, 1, 1)), ("NOPE", DAYS[3])])
        got[side] = {(r.ticker, r.day): r.close for r in A.lookup(pos if from_pages else bars, p, side=side).collect()}
    sat, late, early = dt.date(2021, 1, 9), DAYS[-1] + dt.timedelta(400), dt.date(2020, 1, 1)
    assert [got[s]["RAMP", DAYS[300]] for s in ("<=", "<", ">=")] == [400.0, 399.0, 400.0]
    assert [got[s]["RAMP", sat] for s in ("<=", "<", ">=")] == [104.0, 104.0, 105.0]
    assert [got[s]["RAMP", late] for s in ("<=", "<", ">=")] == [519.0, 519.0, None]
    assert [got[s]["RAMP", early] for s in ("<=", "<", ">=")] == [None, None, 100.0]
    assert got["<="]["NOPE", DAYS[3]] is None


def test_one_ticker_of_all_bars_and_probes(spark):
    """Gaps of months, all sides, against a plain search; no window runs over bars, and no exchange by ticker alone carries the probes."""
    start = dt.date(2015, 3, 17)
    days = [start + dt.timedelta(k) for k in range(0, 2400) if k % 7 < 5 and not 500 < k < 700 and not 1200 < k < 1203]
    one = spark.createDataFrame([("ONE", d, float(k + 1)) for k, d in enumerate(days)], "ticker string, date date, close double").repartition(5)
    asked = [start + dt.timedelta(k) for k in range(-40, 2480, 3)]
    p = spark.createDataFrame([("ONE", d, k) for k, d in enumerate(asked)] + [("ONE", None, -1)], "ticker string, day date, close int")
    pos = A.positioned(one)
    assert {(r.date, r.pos) for r in pos.collect()} == {(d, k + 1) for k, d in enumerate(days)}
    for side in ("<=", "<", ">="):
        found = A.lookup(pos, p, side=side, prefix="x_")
        want = {}
        for d in asked:
            fit = [k for k, b in enumerate(days) if (b <= d if side == "<=" else b < d if side == "<" else b >= d)]
            k = (fit[-1] if side != ">=" else fit[0]) if fit else None
            want[d] = (None, None, None) if k is None else (days[k], float(k + 1), k + 1)
        assert {r.day: (r.x_date, r.x_close, r.x_pos) for r in found.collect()} == want | {None: (None, None, None)}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert all("month" in w for w in plan.splitlines() if "Window [" in w)


def test_forward_return_guards(spark, bars):
    rows = [("a", "RAMP", DAYS[0]), ("stale", "RAMP", DAYS[-1] + dt.timedelta(30)), ("short", "TINY", DAYS[1]), ("end", "RAMP", DAYS[-1]), ("late", "RAMP", DAYS[-1] - dt.timedelta(10))]
    df = spark.createDataFrame(rows, "start_id string, ticker string, start date")
    got = {r.start_id: r.ret for r in A.forward_return(bars, df, 28).collect()}
    assert got["a"] == pytest.approx(0.2) and got["stale"] is None and got["end"] is None
    assert {r.start_id: r.ret for r in A.forward_return(bars, df, 100).collect()}["short"] is None
    assert got["late"] is not None


def test_shift_trading_days(spark, bars):
    df = spark.createDataFrame([("RAMP", DAYS[100], k) for k in (0, 2, -2)] + [("RAMP", dt.date(2021, 1, 9), 1), ("RAMP", DAYS[0], -1)], "ticker string, day date, k int")
    got = {(r.day, r.k): r.shifted for r in A.shift_trading_days(bars, df).collect()}
    assert got[DAYS[100], 0] == DAYS[100] and got[DAYS[100], 2] == DAYS[102] and got[DAYS[100], -2] == DAYS[98]
    assert got[dt.date(2021, 1, 9), 1] == DAYS[6] and got[DAYS[0], -1] is None


def test_coverage(spark, bars):
    rows = spark.createDataFrame([("RAMP", DAYS[200]), ("TINY", DAYS[200]), ("NOPE", DAYS[200]), ("RAMP", dt.date(2030, 1, 4))], "ticker string, as_of_date date")
    got = {(r.ticker, r.as_of_date): (r.priced, r.usable) for r in A.fresh_close_flags(bars, A.priced_flags(bars, rows)).collect()}
    assert got == {("RAMP", DAYS[200]): (True, True), ("TINY", DAYS[200]): (True, False), ("NOPE", DAYS[200]): (False, False), ("RAMP", dt.date(2030, 1, 4)): (True, False)}


def test_split_scan(spark):
    rows = [("FAKE", dt.date(2024, 1, d), c) for d, c in ((5, 100.0), (8, 101.0), (9, 50.0), (10, 51.0))]
    got = A.split_scan(spark.createDataFrame(rows, "ticker string, date date, close double"), F.to_date(F.lit("2024-01-01"))).collect()
    assert [(r.date, r.ratio) for r in got] == [(dt.date(2024, 1, 9), 50 / 101)]


def events(spark, *days, ticker="RAMP"):
    return spark.createDataFrame([(f"e{i}", ticker, d) for i, d in enumerate(days)], "event_id string, ticker string, day date")


def test_abnormal_path(spark, bars, bench):
    got = {r.offset: r.ar for r in T.abnormal_path(events(spark, DAYS[100]), bars, bench, -2, 2).collect()}
    assert got[-1] == 0 and got[0] == pytest.approx(200 / 199 - 1) and got[-2] == pytest.approx(198 / 199 - 1)
    assert T.abnormal_path(events(spark, DAYS[-1]), bars, bench, 0, 2).where("ar is null").count() == 2


def test_event_windows(spark, bars, bench):
    got = {r.offset: r.ret for r in T.event_window(events(spark, DAYS[100]), bars).collect()}
    assert got == {k: pytest.approx((200 + k) / 199 - 1) for k in (1, 5, 20)}
    assert T.event_window(events(spark, DAYS[405]), bars).count() == 0
    assert {r.offset: r.ar for r in T.abnormal_window(events(spark, DAYS[100]), bars, bench).collect()} == {k: pytest.approx(v) for k, v in got.items()}


def test_daily_abnormal(spark, bars, bench):
    """A market that moves too: each day's return of the series less the market's, by plain division."""
    market = [300.0 + (k * k) % 17 for k in range(420)]
    moving = spark.createDataFrame(list(zip(DAYS, market, strict=True)), "date date, close double")
    day = 233
    for ticker in ("RAMP", "SINK"):
        cs = SERIES[ticker]
        got = {r.offset: r.ar for r in T.daily_abnormal(events(spark, DAYS[day], ticker=ticker), bars, moving, -4, 6).collect()}
        assert got == {k: pytest.approx(cs[day + k] / cs[day + k - 1] - market[day + k] / market[day + k - 1]) for k in range(-4, 7)}
    assert T.daily_abnormal(events(spark, DAYS[415]), bars, bench, -4, 6).count() == 0


def test_quiet_ratio(spark):
    rows = [("e", k, 0.05 if k == 0 else 0.01) for k in range(-7, 8)]
    assert T.med_abs_ratio(spark.createDataFrame(rows, "event_id string, offset int, ar double")).first().ratio == pytest.approx(5.0)


def test_path_between(spark, bars, bench):
    """Anchors at the 37th and 164th bar, 7 points and 9 days after; the market stands still, so legs are plain logs."""
    a, z, points, after = 37, 164, 7, 9
    pairs = spark.createDataFrame([("long", "SINK", DAYS[a], DAYS[z]), ("near", "RAMP", DAYS[a], DAYS[a + 11]), ("few", "TINY", DAYS[0], DAYS[2])], "pair_id string, ticker string, d0 date, d1 date")
    rows = T.path_between(pairs, bars, bench, points=points, post_days=after).collect()
    assert {r.pair_id for r in rows} == {"long"}
    between = z - 1 - a  # the second anchor's base is the bar before it
    assert {r.ntd for r in rows} == {between}
    leg = lambda start, end: pytest.approx((end - start) * math.log(0.99))
    got = {(r.leg, r.k): r.v for r in rows}
    assert got == {("p", k): leg(0, round(k / points * between)) for k in range(1, points + 1)} | {("q", k): leg(0, k) for k in range(1, after + 1)} | {
        ("pre20", None): leg(0, 20), ("pre", None): leg(0, between), ("post", None): leg(0, after), ("total", None): leg(0, between + after)
    }


def test_segments(spark, bars, bench):
    segs = {T.segment_name(a, b): (a, b) for a, b in ((0, 30), (30, 90), (0, 90), (-30, 0), (0, 400))}
    got = {r.segment: r for r in T.segment_returns(events(spark, DAYS[200]), bars, bench, segs).collect()}
    assert (1 + got["s_0_30"].raw) * (1 + got["s_30_90"].raw) - 1 == pytest.approx(got["s_0_90"].raw)
    assert got["s_0_400"].raw is None and got["s_-30_0"].raw is not None and got["s_0_30"].bench == 0
    late = {r.segment: r for r in T.segment_returns(events(spark, DAYS[200]), bars, bench, segs, edge_slack_days=500).collect()}
    assert late["s_0_400"].raw is not None and late["s_0_400"].end_date == DAYS[-1]
    assert T.segment_returns(events(spark, dt.date(2020, 1, 1)), bars, bench, segs).count() == 0
    moved = T.segment_returns(events(spark, DAYS[200]), bars, bench, segs, anchor_shift=3).first()
    assert moved.anchor_used == DAYS[200] + dt.timedelta(3)


def _add_months(d, k):
    m = d.month - 1 + k
    y, m = d.year + m // 12, m % 12 + 1
    return dt.date(y, m, min(d.day, [31, 29 if y % 4 == 0 else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]))


def test_forward_paths_match_a_plain_lookup(spark, bars):
    rows = [(f"{t}{k}", t, DAYS[k], 2021, None) for t in ("RAMP", "SINK", "NOSUCH") for k in (30, 90, 150, 210, 270)] + [("before", "RAMP", DAYS[0] - dt.timedelta(60), 2021, None)]
    cut = _add_months(DAYS[30], 3) + dt.timedelta(1)
    rows.append(("cut", "RAMP", DAYS[30], 2021, cut))
    df = spark.createDataFrame(rows, "entry_id string, ticker string, as_of_date date, year int, listed_until date")
    got = T.forward_paths(df, bars, 6).collect()
    assert len({r.entry_id for r in got}) == 11
    for r in got:
        if r.entry_id != "cut":
            start, cs = next(x[2] for x in rows if x[0] == r.entry_id), SERIES[r.ticker]
            at = lambda d: [c for day, c in zip(DAYS, cs) if day <= d][-1]
            day = _add_months(start, r.k)
            want = None if day > DAYS[-1] + dt.timedelta(45) else at(day) / at(start) - 1
            assert r.r == want or r.r == pytest.approx(want)
    cuts = {r.k: r for r in got if r.entry_id == "cut"}
    assert all(cuts[k].r is not None for k in (1, 2, 3)) and all(cuts[k].r is None for k in (4, 5, 6)) and cuts[1].delisted_in_window


def _plain_curve(paths, months):
    """Months of failure (a loss of half or more) and of leaving, and the share that has failed by each month."""
    ends = {}
    for i, vs in paths.items():
        known = [k for k, v in enumerate(vs, 1) if v is not None]
        ends[i] = (next((k for k in known if vs[k - 1] <= -0.5), None), max(known, default=0))
    alive, curve = 1.0, {}
    for k in range(1, months + 1):
        risk = [i for i, (fail, last) in ends.items() if (fail or last) >= k]
        failed = [i for i in risk if ends[i][0] == k]
        alive *= 1 - len(failed) / len(risk) if risk else 1
        curve[k] = 1 - alive
    return ends, curve


def _made_paths():
    """Twenty-three paths of nine months: each falls by its own step and is seen for its own time."""
    return {f"p{j}": [round(-((j * 7) % 11) / 60 * k, 6) if k <= 3 + (j * 5) % 7 else None for k in range(1, 10)] for j in range(23)}


def test_kaplan_meier(spark):
    made = _made_paths()
    paths = spark.createDataFrame([(i, k + 1, v) for i, vs in made.items() for k, v in enumerate(vs)], "id string, k int, r double")
    ends, want = _plain_curve(made, 9)
    assert {f is None for f, _ in ends.values()} == {True, False}
    assert {r.id: (r.fail, r.last) for r in S.failure_times(paths, ["id"]).collect()} == ends
    curve = S.survival_curve(paths, ["id"], 9)
    assert {r.k: r.incidence for r in curve.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    for level in (0.1, 0.3, 0.99):
        assert S.crossing(curve, level).first().month == next((k for k, v in want.items() if v >= level), None)
    with pytest.raises(ValueError, match="censored"):
        S.survival_curve(paths, ["id"], 9, event="ended")
    with pytest.raises(ValueError, match="no column"):
        S.survival_curve(paths, ["id"], 9, value="x")
    all_fail = spark.createDataFrame([("A", 1, 1), ("B", 1, 1)], "id string, fail int, last int")
    assert [r.incidence for r in S.kaplan_meier(all_fail, 3).orderBy("k").collect()] == [1.0, 1.0, 1.0]


HEADER = "<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\n"


def test_price_files(spark, tmp_path):
    def write(folder, name, rows):
        p = tmp_path / "daily" / "us" / folder / "1"
        p.mkdir(parents=True, exist_ok=True)
        (p / f"{name}.us.txt").write_text(HEADER + "".join(rows))

    line = lambda t, d, c, v="1000": f"{t}.US,D,{d},000000,{c},{c},{c},{c},{v},0\n"
    write("nasdaq stocks", "live", [line("LIVE", "20240105", 100), line("LIVE", "20241399", 1), "short,row\n", line("LIVE", "20240108", "x"), line("LIVE", "20240109", 50, "12.0")])
    write("nasdaq ETFs", "ghost", [line("GHOST", "20240105", 10)])
    write("nasdaq etfs", "live", [line("LIVE", "20240105", 7)])
    write("nasdaq stocks", "brk-b", [line("BRK-B", "20240105", 10)])
    bars = I.read_bars(spark, str(tmp_path))
    assert {r.ticker for r in I.symbol_index(bars).collect()} == {"LIVE", "BRK-B"}
    assert {(r.ticker, r.is_fund) for r in I.symbol_index(bars, include_funds=True).collect()} == {("LIVE", False), ("BRK-B", False), ("GHOST", True)}
    assert [(r.date, r.close, r.volume) for r in I.indexed_bars(bars).where("ticker = 'LIVE'").orderBy("date").collect()] == [(dt.date(2024, 1, 5), 100.0, 1000), (dt.date(2024, 1, 9), 50.0, 12)]
    assert spark.range(1).select(I.symbol_key(F.lit("brk.b"))).first()[0] == "BRK-B"
