"""Panel, share, name, resampling and reader operators on inputs small enough to work out by hand."""

import datetime as dt
import gzip
import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyard.functions import names as FN
from panelyard.functions.calendar import overlap_year, quarter_end, quarter_index, quarter_label
from panelyard.operators import matching as M
from panelyard.operators import names as N
from panelyard.operators import nulls as NU
from panelyard.operators import panel as P
from panelyard.operators import resample as B
from panelyard.operators import shares as S
from panelyard.operators import variance as VA
from panelyard.sources import readers as I
from panelyard.sources import schemas

D = dt.date


def quarter_ends(first, last):
    y, q = first
    while (y, q) <= last:
        yield D(y + (q == 4), q * 3 % 12 + 1, 1) - dt.timedelta(1)
        y, q = (y + 1, 1) if q == 4 else (y, q + 1)


def test_quarters(spark):
    r = spark.sql("select date'2026-05-03' d").select(quarter_index(F.col("d")).alias("q")).select("q", quarter_label(F.col("q")).alias("l"), quarter_end(F.col("q")).alias("e")).first()
    assert (r.q, r.l, r.e) == (2026 * 4 + 1, "2026Q2", D(2026, 6, 30))


def test_transitions_and_outcomes(spark):
    """Every firm's panel of eight years by a rule; pairs against plain ones."""
    rows = []
    for firm in range(7, 19):
        for year in range(1987, 1995):
            if (firm * year) % 11 == 3:
                continue  # no row that year
            fiscal = year - (firm % 4 == 1 and year > 1990)  # some firms stop filing a year late
            margin = None if (firm + year) % 13 == 0 else ((firm * 17 + year * 29) % 260 - 120) / 100
            rows.append((firm, year, fiscal, 40.0 + firm * (year - 1980), margin))
    dec = spark.createDataFrame(rows, "cik long, year int, fiscal_year int, revenue double, operating_margin double")
    by = {(r[0], r[1]): r for r in rows}
    for gap in (1, 2):
        pairs = {(f, y): (r, by[f, y + gap]) for (f, y), r in by.items() if (f, y + gap) in by and by[f, y + gap][2] >= r[2] + gap}
        fine = {k: v for k, v in pairs.items() if all(x[4] is not None and abs(x[4]) < 1 for x in v)}
        assert 0 < len(fine) < len(pairs)
        got = {(r.cik, r.base_year): r for r in P.add_outcomes(P.transitions(dec, gap)).collect()}
        assert got.keys() == fine.keys()
        for k, (a, z) in fine.items():
            assert got[k].d_opm == pytest.approx(z[4] - a[4]) and got[k].rev_growth == pytest.approx(z[3] / a[3] - 1) and got[k].revenue_next == z[3]
            assert "d_gm" not in got[k].asDict()
        assert P.add_outcomes(P.transitions(dec, gap), drop_absurd_margins=False).count() == len(pairs)


def test_december_universe(spark):
    rows = [("A", 1, D(2012, 12, 31), 5.0, True), ("A", 1, D(2012, 9, 30), 5.0, True), ("B", 2, D(2012, 12, 31), 5.0, True), ("B", 3, D(2014, 3, 31), 5.0, True), ("C", 4, D(2012, 12, 31), 0.0, True), ("E", 5, D(2012, 12, 31), 5.0, False), ("G", 6, D(2009, 12, 31), 5.0, True)]
    panel = spark.createDataFrame(rows, "ticker string, cik long, as_of_date date, revenue double, is_listed_equity boolean")
    assert [(r.cik, r.year) for r in P.december_snapshots(panel).collect()] == [(1, 2012)]
    assert {r.cik for r in P.universe(panel).collect()} == {1, 6}


def _filed(firm, quarter):
    """The fiscal year a made-up firm shows in a quarter: a new one every four, five or six quarters, none in every ninth."""
    return None if (firm + quarter) % 9 == 8 else 1970 + quarter // (4 + firm % 3)


def test_refresh_events(spark):
    ends = list(quarter_ends((1971, 2), (1976, 1)))
    rows = [(firm, d, _filed(firm, q)) for firm in range(31, 37) for q, d in enumerate(ends) if (firm * q) % 7 != 5]
    panel = spark.createDataFrame(rows, "cik int, as_of_date date, fiscal_year int").repartition(3)
    first = {}
    for firm, d, fy in rows:
        if fy is not None:
            first[firm, fy] = min(d, first.get((firm, fy), d))
    start = {firm: min(d for f, d, _ in rows if f == firm) for firm in range(31, 37)}
    assert {(r.cik, r.fiscal_year, r.as_of_date) for r in P.record_refresh_events(panel).collect()} == {(*k, d) for k, d in first.items()}
    for r in P.record_refresh_events(panel, events_only=False).collect():
        began = first.get((r.cik, r.fiscal_year))
        assert r.is_refresh == (r.as_of_date == began) and r.first_panel_row == (r.as_of_date == start[r.cik])
        assert r.fy_age_days == (began and (r.as_of_date - began).days)


def test_exits(spark):
    ends = list(quarter_ends((1981, 1), (1990, 4)))
    left = {51: 12, 52: 25, 53: len(ends) - 1, 54: 33}  # a firm's last quarter
    rows = [(firm, d, 1980 + min(q, last - firm % 4) // 4) for firm, last in left.items() for q, d in enumerate(ends[: last + 1])]
    panel = spark.createDataFrame(rows, "cik int, as_of_date date, fiscal_year int")
    seen = defaultdict(list)
    for firm, d, fy in rows:
        seen[firm].append((d, fy))
    last_row = {f: v[-1][0] for f, v in seen.items()}
    refreshed = {f: min(d for d, fy in v if fy == v[-1][1]) for f, v in seen.items()}
    later = lambda d, quarters: ends.index(d) + quarters
    for runway in (3, 8):
        for anchor, at in (("last_row", last_row), ("last_refresh", refreshed)):
            got = {r.cik: r for r in P.exit_frame(panel, runway, anchor=anchor).collect()}
            for f in left:
                assert (got[f].last_row, got[f].last_refresh, got[f].exit_date) == (last_row[f], refreshed[f], at[f])
                assert got[f].stale_tail_quarters == ends.index(last_row[f]) - ends.index(refreshed[f])
                assert got[f].exit == (later(at[f], runway) < len(ends)), (f, runway, anchor)
    with pytest.raises(ValueError, match="anchor"):
        P.exit_frame(panel, anchor="middle")
    for r in P.exit_rows(panel, P.exit_frame(panel, 8), 8).collect():
        seen_out = later(r.as_of_date, 8) < len(ends)
        assert r.exit == (float(ends.index(last_row[r.cik]) <= later(r.as_of_date, 8)) if seen_out else None)
        assert r.after_last_refresh == (r.as_of_date > refreshed[r.cik])


def test_bins(spark):
    nine = spark.createDataFrame([(2020, float(v), i) for i, v in enumerate([0] * 6 + [1, 2, 3])], "year int, v double, id int")
    assert [r.bin for r in P.qcut_within(nine, "v", "year", ["id"], 3, 3).orderBy("id").collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    thin = spark.createDataFrame([(2020, 1.0, 1), (2020, 2.0, 2)] + [(2021, float(i), i) for i in range(30)] + [(2021, None, 99)], "year int, v double, id int")
    got = P.qcut_within(thin, "v", "year", ["id"]).collect()
    assert all(r.bin is None for r in got if r.year == 2020 or r.v is None) and all(r.bin for r in got if r.year == 2021 and r.v is not None)
    assert [r.bin for r in P.edge_bins(nine, "v", ["year"], 3).orderBy("id").collect()] == [0] * 6 + [1] * 3
    assert [r.tercile for r in P.tercile(nine, "v", ["year"], ["id"]).orderBy("id").collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    b = spark.createDataFrame([(x,) for x in (0.0, 30.0, 30.5, 100.0, 101.0, None)], "x double").select(P.fixed_buckets(F.col("x"), [0, 30, 50, 70, 85, 100]).alias("b")).collect()
    assert [r.b for r in b] == [0, 0, 1, 4, None, None]


def test_cohort_median_is_taken_off(spark):
    rows = [(k % 4 if k % 23 else None, float((k * 71) % 97), None if k % 6 == 0 else float((k * 5) % 31)) for k in range(150)]
    df = spark.createDataFrame(rows, "cohort int, v double, u double")
    mid = {(c, i): np.median([r[i] for r in rows if r[0] == c and r[i] is not None]) for c in range(4) for i in (1, 2)}
    out = P.market_adjust(df, ["v", "u"], ["cohort"]).collect()
    assert len(out) == 150
    for r in out:
        for name, i in (("v", 1), ("u", 2)):
            want = None if r.cohort is None or r[name] is None else r[name] - mid[r.cohort, i]
            assert r[f"{name}_adj"] == (want if want is None else pytest.approx(want))


def test_presample_label(spark):
    rows = [(f, y, v) for f, v in ((1, 10.0), (2, 20.0)) for y in (2010, 2011, 2014, 2015)] + [(3, 2010, 5.0), (3, 2015, 5.0)]
    df = spark.createDataFrame(rows, "cik int, year int, v double")
    got = P.presample_label(df, "v", (2010, 2012), (2014, 2016)).collect()
    assert {(r.cik, r.label) for r in got} == {(1, 10.0), (2, 20.0)} and len(got) == 4
    with pytest.raises(ValueError, match="touch"):
        P.presample_label(df, "v", (2010, 2014), (2014, 2016))


def test_states_count_null_as_false(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 1.0), (3, None, None)], "id int, a double, b double")
    got = Counter((r.id, r.state) for r in P.with_states(df, {"a": F.col("a") < 2, "b": F.col("b") < 2}).collect())
    assert set(got) == {(1, "a"), (1, "any"), (2, "a"), (2, "b"), (2, "any"), (2, "two or more"), (3, "none")}


def test_revisions(spark):
    rng = np.random.default_rng(6)
    rows = [(f"T{rng.integers(3)}", None if k % 10 == 0 else f"f{rng.integers(9)}", D(1999, 1 + k % 4, 9), float(rng.integers(-40, 41)) / 100, f"c{k}") for k in range(90)]
    facts = spark.createDataFrame(rows, "ticker string, changedAccession string, changedFiled date, relDelta double, conceptGroup string")
    filings = defaultdict(list)
    for ticker, accession, filed, size, _ in rows:
        filings[ticker, accession or filed.isoformat()].append(size)
    got = {(r.ticker, r.filing): r for r in P.revision_filings(facts, threshold=0.25).collect()}
    assert got.keys() == filings.keys()
    for k, sizes in filings.items():
        r = got[k]
        assert (r.n_facts, r.max_abs_rel) == (len(sizes), max(map(abs, sizes))) and abs(r.rel_delta) == r.max_abs_rel
        assert (r.any_down, r.any_up) == (min(sizes) <= -0.25, max(sizes) >= 0.25)
    by_day = P.revision_filings(facts.drop("changedAccession"))
    assert by_day.count() == len({(t, f) for t, _, f, _, _ in rows})


def test_overlap(spark):
    one = spark.sql("select date'2020-12-31' pe, date'2020-01-02' a, date'2020-12-31' b, date'2021-01-01' c, date'2021-12-31' d")
    got = one.select(overlap_year(F.col("pe"), F.col("a"), F.col("b")).alias("x"), overlap_year(F.col("pe"), F.col("c"), F.col("d")).alias("y")).first()
    assert got.x == pytest.approx(364 / 365) and got.y == 0


def series(spark, counts):
    return spark.createDataFrame([(1, y, float(v) if v is not None else None) for y, v in counts.items()], "cik long, fiscal_year int, shares double")


FLAGGED = {
    "up": ({2010: 40, 2011: 41, 2012: 124, 2013: 125}, [(2012, 124 / 41, 3.0)]),
    "down": ({2005: 700, 2006: 690, 2007: 69.5}, [(2007, 69.5 / 690, 0.1)]),
    "a year is missing": ({2001: 10, 2003: 20}, []),
    "no count before": ({2001: 10, 2002: None, 2003: 20}, []),
    "zero before": ({2001: 0, 2002: 30}, []),
    "no whole factor": ({2001: 10, 2002: 25.9}, []),
}


@pytest.mark.parametrize("case", FLAGGED)
def test_split_flags(spark, case):
    counts, want = FLAGGED[case]
    assert [(r.flag_year, pytest.approx(r.ratio), r.factor) for r in S.split_basis_flags(series(spark, counts)).collect()] == [(y, pytest.approx(ratio), f) for y, ratio, f in want]


def _verdict(spark, outstanding):
    flag = spark.createDataFrame([(1, 2014, 3.0, 3.0)], "cik long, flag_year int, ratio double, factor double")
    return S.corroborate_flags(flag, series(spark, outstanding)).first()


def test_corroboration(spark):
    r = _verdict(spark, {2013: 50, 2014: 51, 2015: 152})
    assert (r.verdict, r.step_year) == ("corroborated", 2015)
    r = _verdict(spark, {2013: 50, 2014: 150, 2015: 151})  # the step stands in the flag's own year: nothing after it
    assert r.verdict == "contradicted"
    assert _verdict(spark, {2014: 60}).verdict == "untestable"
    assert _verdict(spark, {2014: None, 2015: None}).verdict == "untestable"


def test_rebase_and_sanity(spark):
    splits = spark.createDataFrame([(1, 2012, 3.0)], "cik long, split_year int, factor double")
    got = {r.fiscal_year: r.rebased for r in S.rebase(series(spark, {2010: 40, 2011: 41, 2012: 124}), splits).collect()}
    assert got == {2010: 120, 2011: 123, 2012: 124}
    thousands = [(1, 2008, 9.1e7, 9.1e4), (1, 2009, 9.2e7, 9.2e4), (1, 2010, 9.3e7, 9.4e7), (1, 2011, 0.0, 9.0)]
    both = spark.createDataFrame(thousands, "cik long, fiscal_year int, outstanding double, diluted double")
    assert sorted(r.fiscal_year for r in S.series_sanity(both).collect()) == [2008, 2009]


@pytest.mark.parametrize("factor, want", [(5.1, (5.0, True)), (0.34, (1 / 3, True)), (2.45, (2.45, False))])
def test_snap(spark, factor, want):
    r = spark.createDataFrame([(factor,)], "f double").select(S.snap(F.col("f")).alias("s")).select("s.*").first()
    assert (pytest.approx(r.factor), r.snapped) == want


def test_firm_basis(spark):
    def basis(steps):
        rows = [(1, 2003 + k, float(a), float(b), None) for k, (a, b) in enumerate(steps)]
        return S.firm_basis(spark.createDataFrame(rows, "cik long, fiscal_year int, outstanding double, diluted double, implied double")).collect()

    (r,) = basis([(70, 70), (70, 70), (70, 210), (70, 210), (210, 210)])
    assert (r.split_year, r.factor, r.run_len, r.resolved) == (2007, 3.0, 2, True)
    (r,) = basis([(70, 210), (70, 210), (70, 210), (210, 210)])
    assert (r.first_year, r.last_year, r.resolved, r.factor) == (2003, 2005, False, None)


def test_cap_and_decomposition(spark):
    one = spark.sql("select 250D s, 0D z, 8D p, date'2016-09-30' late, date'2016-03-31' early, date'2016-06-30' day")
    cap = lambda s, until: S.market_cap(F.col(s), F.col("p"), F.col(until), F.col("day"))
    r = one.select(cap("s", "early").alias("known"), cap("s", "late").alias("ahead"), cap("z", "early").alias("none")).first()
    assert (r.known, r.ahead, r.none) == (2000, None, None)
    d = one.select(S.decompose(*(F.lit(v) for v in (5.0, 20.0, 100.0, 300.0, 10.0, 15.0))).alias("d")).first()["d"]
    assert tuple(d) == pytest.approx((4.0, 2.0, 2.0))


CORES = {
    "Quillmoor Optics Holdings, Ltd.": "quillmoor optics", "TARNBECK PLC /GB/": "tarnbeck", "Fennick et al": "fennick", "Harrow & Pike Group": "harrow pike", "Ostrava-Nord 7 GmbH": "ostrava nord 7",
    None: "", "The Company of the Group": "",
}


def test_cores(spark):
    got = spark.createDataFrame([(n,) for n in CORES], "n string").select("n", FN.core(F.col("n"))).collect()
    assert {n: c for n, c in got} == CORES


def test_usable(spark):
    fine, not_fine = {"tarnb", "labs tarnb", "7 tarnb", "quillmoor"}, {"", "labs", "tarn", "56789", "genomics"}
    got = spark.createDataFrame([(c,) for c in fine | not_fine], "c string").select("c", FN.usable(F.col("c")).alias("u")).collect()
    assert {r.c for r in got if r.u} == fine
    more = spark.createDataFrame([("quillmoor",)], "c string").select(FN.usable(F.col("c"), ["quillmoor"])).first()[0]
    assert more is False


RULED = {
    ("quillmoor optics", "quillmoor optics"): "R1", ("tarnbeck", "tarnbecks"): "R2", ("tarnbeckus", "tarnbeck"): "R2", ("tarnbeck", "tarnbeckish"): None, ("tarnb", "tarnbs"): None,
    ("tarnbeck", "tarnbeck optics nord"): "R3", ("tarnbeck", "tarnbeck a b c"): None, ("tarnbeck labs", "tarnbeck"): "R3b", ("tarnbeck labs 7", "tarnbeck"): "R3b", ("tarnbeck optics", "tarnbeck"): None,
    ("nord tarnbeck", "tarnbeck"): None, ("labs", "labs optics"): None, ("pike pike", "pike pike pike"): None,
}


def test_rules(spark):
    rows = spark.createDataFrame(list(RULED), "a string, b string").select("a", "b", FN.rule(F.col("a"), F.col("b")).alias("r")).collect()
    assert {(r.a, r.b): r.r for r in rows} == RULED
    stopped = spark.createDataFrame([("tarnbeck optics", "tarnbeck")], "a string, b string").select(FN.rule(F.col("a"), F.col("b"), ["optics"])).first()[0]
    assert stopped == "R3b"


def test_pairs_of_all_rules_meet(spark):
    rng = np.random.default_rng(5)
    words = ["tarnbeck", "tarnbecks", "tarnbeckus", "quill", "optics", "nord", "labs", "japan", "7", "b2", "pike", "genomics"]
    some = sorted({" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(400)})
    cores = spark.createDataFrame([(s,) for s in some], "c string")
    for extra in ([], ["quill", "pike"]):
        want = cores.alias("a").crossJoin(cores.alias("b")).where(FN.usable(F.col("a.c"), extra) & FN.usable(F.col("b.c"), extra)).withColumn("rule", FN.rule(F.col("a.c"), F.col("b.c"), extra)).where("rule is not null")
        want = {(r[0], r[1], r[2]) for r in want.collect()}
        assert {w[2] for w in want} == {"R1", "R2", "R3", "R3b"}
        left = N.blocks(cores, "c", True, extra).collect()
        right = {}
        for r in N.blocks(cores, "c", False, extra).collect():
            right.setdefault(r.block, set()).add(r.c)
        met = {(r.c, c) for r in left for c in right.get(r.block, ())}
        assert {w[:2] for w in want} <= met and len(met) < 0.2 * len(some) ** 2


def test_names_of_common_words_do_not_meet_on_one_key(spark):
    """800 names that begin alike and hold words that may go only: all pairs found, no key with over a hundredth of all pairs."""
    rng = np.random.default_rng(8)
    common = [w for w in FN.STOPWORDS if w != "new"]
    some = sorted({" ".join(["new", *rng.choice(common, rng.integers(1, 5), replace=False)]) for _ in range(800)})
    cores = spark.createDataFrame([(s,) for s in some], "c string")
    sets, stop = {s: set(s.split()) for s in some}, set(FN.STOPWORDS)
    want = {(a, b) for a in some for b in some if a != b and sets[b] < sets[a] and len(sets[b]) >= 2 and all(len(t) <= 2 or t in stop for t in sets[a] - sets[b])}
    left, right = defaultdict(set), defaultdict(set)
    for df, held in ((N.blocks(cores, "c", True), left), (N.blocks(cores, "c", False), right)):
        for r in df.collect():
            held[r.block].add(r.c)
    met = {(a, b) for k in left for a in left[k] for b in right.get(k, ())}
    assert want and want <= met
    assert max(len(left[k]) * len(right.get(k, ())) for k in left) < 0.01 * len(some) ** 2


def test_match_against_comparing_everything(spark):
    rng = np.random.default_rng(0)
    words = ["quorlim", "quorlimon", "alpha", "delta", "pharma", "japan", "labs", "omega", "quorlimonpq", "inc", "k1"]
    some = sorted({" ".join(rng.choice(words, rng.integers(1, 4))) for _ in range(120)})
    al = spark.createDataFrame([(f"k{i}", s) for i, s in enumerate(some[::2])], "key string, alias string")
    ca = spark.createDataFrame([(s.title(),) for s in some], "candidate string")
    got = {(r.key, r.candidate, r.rule) for r in N.match_all(al, ca).collect()}
    a = al.select("key", FN.core(F.col("alias")).alias("a")).where(FN.usable(F.col("a")))
    c = ca.select("candidate", FN.core(F.col("candidate")).alias("c")).where(FN.usable(F.col("c")))
    want = {(r.key, r.candidate, r.rule) for r in a.crossJoin(c).withColumn("rule", FN.rule(F.col("a"), F.col("c"))).where("rule is not null").collect()}
    assert got == want and want
    assert len({r.candidate for r in N.match(al, ca).collect()} & {r.candidate for r in N.match_all(al, ca).where("ambiguous").collect()}) == 0


def test_ambiguity_and_spellings(spark):
    al = spark.createDataFrame([("1", "Quorlim Pharma"), ("2", "Quorlim Labs"), ("3", "Omega Tools")], "key string, alias string")
    ca = spark.createDataFrame([("Quorlim",), ("Omega Tools Inc",), ("OMEGA TOOLS",), ("omega, tools llc",)], "candidate string")
    assert {(r.key, r.candidate) for r in N.match(al, ca).collect()} == {("3", "Omega Tools Inc"), ("3", "OMEGA TOOLS"), ("3", "omega, tools llc")}
    d = N.diagnostics(al, ca).first()
    assert (d.raw_pairs, d.pairs_dropped, d.ambiguous_candidate_names, d.keys_matched, d.by_r1) == (5, 2, 1, 1, 3)
    two = spark.createDataFrame([("1", "quorlim delta")], "key string, alias string"), spark.createDataFrame([("quorlim",)], "candidate string")
    assert N.match(*two).count() == 0 and N.match(*two, extra_stopwords=["delta"]).first().rule == "R3b"


def test_registrants(spark):
    text = json.dumps({"0": {"cik_str": 111, "ticker": "AAAA", "title": "A"}, "1": {"cik_str": 111, "ticker": "AAAB", "title": "A2"}, "2": {"cik_str": 222, "ticker": "BBBB", "title": "B"}, "3": {"cik_str": 333, "ticker": "BBBB", "title": "C"}, "4": {"cik_str": 111, "ticker": "AAAA", "title": "A"}})
    reg = I.registrants(spark.createDataFrame([(text,)], "value string"))
    assert {r.cik: (r.name, r.tickers) for r in reg.collect()} == {111: ("A", ["AAAA", "AAAB"]), 222: ("B", ["BBBB"]), 333: ("C", ["BBBB"])}
    assert {r.ticker: r.ciks for r in I.holders(reg).collect()}["BBBB"] == [222, 333]
    asked = spark.createDataFrame([("0000000222",), ("999",), ("x",)], "cik string")
    assert {r.cik: r.name for r in I.by_cik(asked, reg).collect()} == {"0000000222": "B", "999": None, "x": None}


def test_history_documents(spark, tmp_path):
    docs = [{"cikNumber": 11, "years": [{"fiscalYear": 2019, "periodEnd": "2019-12-31"}, {"fiscalYear": 2020, "periodEnd": "2020-12-31"}, {"fiscalYear": None, "periodEnd": "2020-12-31"}]}, {"error": "gone"}, {"cikNumber": 22, "years": [{"fiscalYear": 2020, "periodEnd": "2021-01-30"}, {"fiscalYear": 2020, "periodEnd": "2021-01-02"}]}]
    for k, d in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(d))
    got = {(r.cik, r.fiscal_year): r for r in I.fiscal_years(I.read_json(spark, str(tmp_path), schemas.HISTORY)).collect()}
    assert len(got) == 3 and (got[22, 2020].year_offset, got[22, 2020].month_day) == (-1, "01-30")


def test_panel_reader(spark, tmp_path):
    head = "as_of_date,ticker,cik,sector,fiscal_year,revenue,net_margin,is_listed_equity\n"
    with gzip.open(tmp_path / "sample.csv.gz", "wt") as f:
        f.write(head + "2020-12-31,A,0000000007,x,2020.0,5.5,NaN,True\n")
    full, sample = str(tmp_path / "full.csv"), str(tmp_path / "sample.csv.gz")
    r = I.read_panel(spark, full, sample).first()
    assert (r.as_of_date, r.cik, r.fiscal_year, r.revenue, r.net_margin, r.is_listed_equity, r.listed_until) == (D(2020, 12, 31), 7, 2020, 5.5, None, True, None)
    (tmp_path / "full.csv").write_text(head + "2020-12-31,B,8,x,2020,1,0.1,false\n")
    assert I.read_panel(spark, full, sample).first().ticker == "B"
    with pytest.raises(FileNotFoundError, match="neither"):
        I.read_panel(spark, full + "x", sample + "x")


def test_samples_and_pins(spark, tmp_path):
    df = spark.range(300).selectExpr("id % 30 as cik", "date_add(date'2020-01-01', cast(id as int)) as as_of_date", "id % 3 as stratum")
    cut = I.entity_sample(df, "cik", 7, 1)
    assert cut.count() == 70 and cut.select("cik").distinct().count() == 7
    I.write_sample_csv(cut, str(tmp_path / "cut"))
    lines = gzip.open(next((tmp_path / "cut").glob("*.csv.gz")), "rt").read().splitlines()[1:]
    assert lines == sorted(lines, key=lambda x: (int(x.split(",")[0]), x.split(",")[1]))
    s = I.stratified_sample(df, "cik", "stratum", 10, 3, 1).collect()
    assert len(s) == 10 and min(Counter(r.stratum for r in s).values()) >= 3
    first = I.pinned(lambda: spark.range(3), spark, str(tmp_path / "pin")).count()
    assert first == 3 == I.pinned(lambda: spark.range(9), spark, str(tmp_path / "pin")).count()


def test_bootstrap(spark):
    df = spark.createDataFrame([("A", 0.0)] * 50 + [("B", 10.0)] * 50 + [("C", None)], "g string, v double")
    r = B.cluster_bootstrap(df, "v", "g", "mean", 200)
    assert (r.first().obs, r.first().lo <= 0.5, r.first().hi >= 9.5) == (5.0, True, True)
    per = B.multiplicities(df.where("v is not null"), "g", 200).groupBy("draw").agg(F.sum("w").alias("w")).collect()
    assert len(per) == 200 and {x.w for x in per} == {2}
    none = B.cluster_bootstrap(df.where("g = 'C'"), "v", "g").first()
    assert (none.obs, none.lo, none.hi) == (None, None, None)
    with pytest.raises(ValueError, match="stat"):
        B.cluster_bootstrap(df, "v", "g", "max")


@pytest.mark.parametrize("stat", ["mean", "median"])
def test_boot_diff_shares_one_draw(spark, stat):
    rows = [("A1", "a", 10.0), ("A1", "a", 10.0), ("A2", "a", 10.0), ("B1", "b", 4.0), ("B2", "b", 4.0), ("B2", "b", 4.0), ("B2", "b", float("inf")), ("B2", "b", None)]
    r = B.cluster_boot_diff(spark.createDataFrame(rows, "g string, side string, v double"), "v", "g", "side", stat, 100).first()
    assert (r.obs, r.lo, r.hi, r.share_le_0, r.n_a, r.n_b, r.tied) == (6, 6, 6, 0, 3, 3, False)
    tied = spark.createDataFrame([(f"g{k}", s, 0.0 if k % 10 < 8 else 1.0) for k in range(100) for s in "ab"], "g string, side string, v double")
    assert B.cluster_boot_diff(tied, "v", "g", "side", "median", 50).first().tied


def test_ratio_and_extremes(spark):
    num = spark.createDataFrame([(f"g{k}", 2.0) for k in range(5)], "g string, v double")
    den = spark.createDataFrame([(f"g{k}", 1.0) for k in range(5)] * 2, "g string, v double")
    assert tuple(B.boot_ratio(num, den, "v", "g", "median", 50).first()) == (2.0, 2.0, 2.0)
    rows = [(f"f{k}", q, y) for k in range(20) for q, y in ((1, 1.0), (2, 0.5), (3, 0.0), (4, 0.5), (5, 1.0))]
    r = B.extremes_vs_middle(spark.createDataFrame(rows, "cik string, q int, y double"), "q", "y", "cik", draws=50).first()
    assert (r.obs, r.n_a, r.n_b) == (1.0, 40, 20)


def shuffle_frame(spark, drop=()):
    rows = [(f"{c}|{y}|{q}", c, y, q, c * 100 + y * 10 + q, c) for c in range(8) for y in range(3) for q in range(4) if (c, y) not in drop]
    return spark.createDataFrame(rows, "id string, cik int, year int, q int, label int, firm_label int")


def test_clustered_shuffle_invariants(spark):
    df = shuffle_frame(spark)
    rows = NU.clustered_shuffle(df, "label", "cik", "id", "year", draws=3).collect()
    assert len(rows) == 3 * 96 and not any(r.fell_back for r in rows)
    for d in (1, 2, 3):
        for y in range(3):
            assert Counter(r.shuffled for r in rows if r.draw == d and r.year == y) == Counter(r.label for r in rows if r.draw == d and r.year == y)
    for frame in (df, shuffle_frame(spark, {(0, 0), (3, 1), (3, 2)})):
        out = NU.clustered_shuffle(frame, "firm_label", "cik", "id", "year", draws=2).collect()
        assert len(out) == 2 * frame.count() and all(r.shuffled is not None for r in out)
        held = defaultdict(set)
        for r in out:
            held[r.draw, r.cik].add(r.shuffled)
        assert all(len(v) == 1 for v in held.values())
    strings = df.withColumn("m", F.concat(F.lit("2024-0"), F.col("year") + 1))
    assert NU.clustered_shuffle(strings, "label", "cik", "id", "m").count() == 96
    assert NU.clustered_shuffle(df, "label", "cik", "id").count() == 96


def test_within_shuffles_keep_the_multiset(spark):
    df = shuffle_frame(spark)
    for by in (["cik"], ["year", "q"]):
        a, b = defaultdict(Counter), defaultdict(Counter)
        for r in NU.within_shuffle(df, "label", by, "id", draws=2).collect():
            a[(r.draw, *(r[c] for c in by))][r.label] += 1
            b[(r.draw, *(r[c] for c in by))][r.shuffled] += 1
        assert a == b
    units = NU.unit_shuffle(df, "firm_label", "cik", "q", draws=2).collect()
    assert len(units) == 192 and all(len({r.shuffled for r in units if (r.draw, r.q, r.cik) == k}) == 1 for k in {(r.draw, r.q, r.cik) for r in units})
    assert NU.cell_mean_shuffle(shuffle_frame(spark, {(0, 0)}), "label", "cik", "year").where("shuffled is null").count() == 0


def test_family_chance(spark):
    obs = spark.createDataFrame([("x", 1.0), ("y", 0.0)], "cell string, value double")
    zeros = [(c, "a", d, 0.0) for c in "xy" for d in range(1, 101)]
    r = NU.family_chance(obs, spark.createDataFrame(zeros, "cell string, null_name string, draw int, value double")).first()
    assert (r.n_cells, r.observed_clear, r.draws, r.expected) == (2, 1, 100, 0.0)
    two = zeros + [(c, "b", d, 5.0) for c in "xy" for d in range(1, 101)]
    assert NU.family_chance(obs, spark.createDataFrame(two, "cell string, null_name string, draw int, value double")).first().observed_clear == 0


def test_family_chance_matches_plain_counts(spark):
    rng = np.random.default_rng(3)
    cells = {c: (float(rng.normal() * 2), rng.normal(size=60).round(1)) for c in "pqrs"}
    obs = spark.createDataFrame([(c, v) for c, (v, _) in cells.items()], "cell string, value double")
    nulls = spark.createDataFrame([(c, "n", i + 1, float(x)) for c, (_, n) in cells.items() for i, x in enumerate(n)], "cell string, null_name string, draw int, value double")
    beyond = lambda v, n: float((n >= v).mean() if v >= 0 else (n <= v).mean())
    clear = lambda v, n: beyond(v, n) <= 0.1
    counts = np.array([sum(clear(float(n[i]), n) for _, n in cells.values()) for i in range(60)])
    r = NU.family_chance(obs, nulls, 0.1).first()
    assert r.observed_clear == sum(clear(v, n) for v, n in cells.values())
    assert r.expected == pytest.approx(counts.mean()) and r.sd == pytest.approx(counts.std()) and r.p95 == pytest.approx(np.percentile(counts, 95))


def test_matched_controls(spark):
    cases = spark.createDataFrame([(f"c{k}", k % 3) for k in range(30)] + [("lost", 9)], "case_id string, cell int")
    controls = spark.createDataFrame([(k, 0) for k in range(50)] + [(100, 1), (101, 1)] + [(200 + k, 2) for k in range(4)], "control_id long, cell int")
    got = defaultdict(list)
    for r in M.matched_controls(cases, controls, ["cell"]).collect():
        got[r.case_id].append(r.control_id)
    assert all(len(v) == len(set(v)) for v in got.values())
    assert {len(got[f"c{k}"]) for k in range(0, 30, 3)} == {3} and {len(got[f"c{k}"]) for k in range(1, 30, 3)} == {2}
    assert all(set(got[f"c{k}"]) <= {100, 101} for k in range(1, 30, 3)) and "lost" not in got
    assert [r.case_id for r in M.unmatched(cases, controls, ["cell"]).collect()] == ["lost"]


def test_matched_controls_are_uniform(spark):
    cases = spark.range(3000).selectExpr("cast(id as string) case_id", "0 cell")
    controls = spark.range(5).selectExpr("id control_id", "0 cell")
    n = Counter(r.control_id for r in M.matched_controls(cases, controls, ["cell"]).collect())
    assert len(n) == 5 and max(n.values()) - min(n.values()) < 250


def test_variance_blocks(spark):
    rows = [(2.0 * a + b, float(a), float(b)) for a in (1, -1) for b in (1, -1)] * 10
    df = spark.createDataFrame(rows, "y double, a double, b double")
    r2 = VA.r2_lattice(df, "y", {"A": ["a"], "B": ["b"]})
    assert r2[frozenset("A")] == pytest.approx(0.8) and r2[frozenset("B")] == pytest.approx(0.2) and r2[frozenset("AB")] == pytest.approx(1.0)
    assert sum(x["shapley"] for x in VA.shapley(r2, ["A", "B"])) == pytest.approx(1.0)
    with pytest.raises(ValueError, match="13 blocks"):
        VA.r2_lattice(df, "y", {str(k): ["a"] for k in range(13)})


def test_trajectories_and_nearest(spark):
    panel = spark.createDataFrame([(1, q, float(q * q)) for q in (2, 3, 5)], "cik long, qi int, m double")
    got = {r.k: (r.value, r.change) for r in M.trajectories(spark.createDataFrame([("a", 1, 6)], "aid string, cik long, qi int"), panel, ["m"], -4, -1).collect()}
    assert got == {-4: (4.0, 0.0), -3: (9.0, 5.0), -2: (None, None), -1: (25.0, 21.0)}
    t = spark.createDataFrame([("t1", 0, 5.0), ("t2", 0, 0.0), ("t3", 1, 1.0)], "treated_id string, cell int, v double")
    c = spark.createDataFrame([("c1", 0, 3.0), ("c2", 0, 7.0), ("c3", 0, 9.0)], "control_id string, cell int, v double")
    assert {r.treated_id: r.control_id for r in M.nearest_controls(t, c, ["cell"], "v").collect()} == {"t1": "c1", "t2": "c1", "t3": None}


def test_insiders_and_as_of_values(spark):
    docs = spark.createDataFrame([(json.dumps({"cikNumber": 1, "transactions": [{"code": "P", "isDerivative": False, "value": 5.0, "transactionDate": "2020-01-02"}, {"code": "S", "isDerivative": True, "value": 5.0, "transactionDate": "2020-01-03"}, {"code": "A", "value": 1.0, "transactionDate": "2019-01-01"}, {"code": "S", "value": 0.0, "transactionDate": "2020-01-01"}]}),)], "value string")
    t = I.insider_transactions(docs.select(F.from_json("value", schemas.INSIDER).alias("d")).select("d.*"))
    assert [(r.code, r.side) for r in t.where("open_market").collect()] == [("P", "buy")] and t.agg(F.min("day")).first()[0] == D(2019, 1, 1)
    vals = spark.createDataFrame([(json.dumps({"cikNumber": 1, "values": [{"conceptGroup": "X", "value": 1.0, "filedAt": "2024-05-01"}, {"conceptGroup": "Revenue", "periodEnd": "2020-12-31", "value": 9.0, "filedAt": "2021-02-01"}, {"conceptGroup": "Revenue", "periodEnd": "2019-12-31", "value": 8.0, "filedAt": "2020-02-01"}]}),)], "value string")
    r = I.latest_annual(vals.select(F.from_json("value", schemas.AS_OF).alias("d")).select("d.*")).first()
    assert (r.value, r.period_end, r.probe) == (9.0, D(2020, 12, 31), D(2024, 5, 1))


def test_lookup_outcomes(spark):
    holders = spark.createDataFrame([("AAA", 1), ("AAA", 2), ("BBB", 3)], "ticker string, cik long")
    asked = spark.createDataFrame([(1, "aaa"), (9, "BBB"), (4, "CCC")], "cik long, ticker string")
    assert {r.cik: r.outcome for r in N.lookup_outcome(asked, holders).collect()} == {1: "asked for", 9: "different company", 4: "nothing"}


def test_clustered_logit_matches_plain_newton(spark):
    rng = np.random.default_rng(5)
    x, g = rng.normal(size=400), np.repeat(np.arange(80), 5)
    y = (rng.random(400) < 1 / (1 + np.exp(0.5 - x))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(y, x, g)], "y double, x double, g int")
    got = {r.term: r for r in VA.cluster_logit(df, "y", ["x"], "g").collect()}
    X, beta = np.stack([np.ones(400), x], 1), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ beta))
        info = X.T @ (X * (p * (1 - p))[:, None])
        beta = beta + np.linalg.solve(info, X.T @ (y - p))
    u = np.stack([((y - p)[:, None] * X)[g == k].sum(0) for k in range(80)])
    se = np.sqrt(np.diag(np.linalg.inv(info) @ (u.T @ u) @ np.linalg.inv(info)))
    assert [got["intercept"].coefficient, got["x"].coefficient] == pytest.approx(beta.tolist()) and [got["intercept"].clustered_se, got["x"].clustered_se] == pytest.approx(se.tolist())


def test_shapley_bootstrap(spark):
    rng = np.random.default_rng(6)
    rows = [(k // 4, *map(float, rng.normal(size=2))) for k in range(200)]
    df = spark.createDataFrame([(g, 2 * a + b, a, b) for g, a, b in rows], "cik int, y double, a double, b double")
    got = VA.shapley_bootstrap(df, "y", {"A": ["a"], "B": ["b"]}, "cik", 20).collect()
    plain = {x["block"]: x["shapley"] for x in VA.shapley(VA.r2_lattice(df, "y", {"A": ["a"], "B": ["b"]}), ["A", "B"])}
    assert {r.block: pytest.approx(r.shapley) for r in got if r.draw == 0} == plain
    assert len({r.draw for r in got}) == 21 and all(sum(r.shapley for r in got if r.draw == d) == pytest.approx(1.0) for d in range(21))
