"""Cluster bootstrap by whole groups, with draws that any engine can reproduce.

A draw takes as many groups as there are, with replacement. How often it takes a group comes from a splitting tree over
the groups (functions/draws.py), so a task that holds a range of groups works out their numbers for all draws by itself:
no slots are dealt or exchanged. For means, rates and ratios of means the rows are collapsed to one per group and cell
and added up for all draws inside the tasks: what is shuffled is one row per cell and draw and task. Medians are weighted
exactly: values are numbered in order, each task adds up every draw's weights per range of values, and each
draw descends into the range that holds its middle, 64 times narrower a level, until the range is one value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import multiplicities_of
from ..sources.tables import discard, durable, numbered, settled
from .ranks import null_safe

#: Numbers that a task holds for all draws before it passes them on.
MOST_HELD = 1 << 22
#: Groups whose multiplicities are worked out together at most, and rows that meet them at a time.
RANGE, ROWS = 1024, 2048
#: Bits of a value's number that a level of descent settles.
LEVEL = 6


def indexed(groups: DataFrame, col: str) -> DataFrame:
    """Distinct non-null groups with `idx` from 0 in their order and `n`, their number."""
    own = groups.select(F.col(col).alias("grp")).where("grp is not null").distinct()
    return numbered(own, ["grp"], "idx", "n", twice=hasattr(groups, "written_to"))


def _by_range(df: DataFrame) -> DataFrame:
    """Rows with idx: those of a range of groups in one task, ranges one after the other."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.lit(32), F.least(F.lit(RANGE), F.ceil(F.col("n") / (4 * tasks)))).cast("long")
    return df.withColumn("_size", size).withColumn("_range", F.floor(F.col("idx") / F.col("_size"))).repartition(tasks, "_range").sortWithinPartitions("_range")


def _weighted(batches, draws: int, seed: int):
    """(batch, positions, weights): rows of one range in a batch and what each draw weighs them, in pieces."""
    now, held = None, None
    for b in batches:
        ranges, idx = b.column("_range").to_numpy(), b.column("idx").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1), len(ranges)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a == z:
                continue
            size, n = b.column("_size")[a].as_py(), b.column("n")[a].as_py()
            low = int(ranges[a]) * size
            if low != now:
                now, held = low, multiplicities_of(low, min(low + size, n), n, np.arange(1, draws + 1), seed)
            for at in range(a, z, ROWS):
                rows = slice(at, min(at + ROWS, z))
                yield b, rows, held[idx[rows] - low]


def multiplicities(groups: DataFrame, col: str, draws: int, seed: int = 0) -> DataFrame:
    """(draw, grp, w) for draws 1..draws; groups that a draw leaves out have no row."""
    own = indexed(groups, col)
    kind = own.schema["grp"].dataType.simpleString()

    def run(batches):
        for b, rows, w in _weighted(batches, draws, seed):
            at, draw = np.nonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(draw + 1, pa.int64()), b.column("grp").slice(rows.start, rows.stop - rows.start).take(pa.array(at)), pa.array(w[at, draw], pa.int64())], ["draw", "grp", "w"])

    return _by_range(own).mapInArrow(run, f"draw long, grp {kind}, w long")


class _Cells:
    """Sums by key and draw: keys get numbers as they come, values of a key are added up in blocks."""

    def __init__(self, width: int, draws: int, kind):
        self.at: dict[tuple, int] = {}
        self.sums = np.zeros((width, 64, draws), kind)

    def add(self, keys: list[tuple], values: list[np.ndarray], weights: np.ndarray) -> None:
        code = np.array([self.at.setdefault(k, len(self.at)) for k in keys], np.int64)
        order = np.argsort(code, kind="stable")
        code, weights = code[order], weights[order]
        start = np.flatnonzero(np.diff(code, prepend=-1))
        while len(self.at) > self.sums.shape[1]:
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)], axis=1)
        for i, v in enumerate(values):
            self.sums[i][code[start]] += np.add.reduceat(v[order, None] * weights, start, axis=0)

    def full(self) -> bool:
        return len(self.at) * self.sums.shape[0] * self.sums.shape[2] > MOST_HELD


def _sums(rows: DataFrame, own: DataFrame, keys: list[str], values: list[str], draws: int, seed: int) -> DataFrame:
    """(keys..., draw, values...): per draw the sums of each value times its group's multiplicity;
    rows (keys..., grp, values...), own as from indexed()."""
    held = _by_range(rows.join(own, "grp").select(*keys, *(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values), "idx", "n"))
    schema = held.select(*keys, F.lit(0).cast("long").alias("draw"), *values).schema

    def run(batches):
        kinds: list = []

        def out(cells):
            n = len(cells.at)
            columns = [pa.array([k[i] for k in cells.at], kinds[i]).take(pa.array(np.repeat(np.arange(n), draws))) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(1, draws + 1), n)), *(pa.array(cells.sums[i, :n].ravel()) for i in range(len(values)))], [*keys, "draw", *values])

        cells = _Cells(len(values), draws, float)
        for b, at, w in _weighted(batches, draws, seed):
            kinds = kinds or [b.schema.field(k).type for k in keys]
            part = b.slice(at.start, at.stop - at.start)
            own_keys = list(zip(*(part.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * part.num_rows
            cells.add(own_keys, [part.column(v).to_numpy(zero_copy_only=False) for v in values], w)
            if cells.full():
                yield out(cells)
                cells = _Cells(len(values), draws, float)
        if cells.at:
            yield out(cells)

    return held.mapInArrow(run, schema).groupBy(*keys, "draw").agg(*(F.sum(v).alias(v) for v in values))


def _medians(rows: DataFrame, own: DataFrame, keys: list[str], draws: int, seed: int, least: int = 1, prob: float = 0.5) -> DataFrame:
    """(keys..., draw, m): the exact median (or another quantile) of each draw, rows (keys..., grp, v, c), made from a durable table, standing c times the group's multiplicity.
    Draws with under `least` rows in a cell have none there."""
    values = numbered(rows.select(*keys, "v").distinct(), [*keys, "v"], twice=True)
    placed = durable(null_safe(rows, values, [*keys, "v"]).join(own, "grp").select(*keys, "idx", "n", "pos", "c"), "boot-rows")
    most, every = values.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    bits = LEVEL if (every or 0) * draws > 4 * MOST_HELD else 62  # few values: one level, each its own range
    shifts = range(((most or 1) - 1).bit_length() // bits * bits, -1, -bits)
    needed, spent = None, []
    for shift in shifts:
        parent = F.lit(0).cast("long") if needed is None else F.shiftright("pos", shift + bits)
        level = placed.withColumn("parent", parent).withColumn("sub", F.shiftright("pos", shift))
        if needed is not None:
            level = null_safe(level, needed.select(*keys, "parent"), [*keys, "parent"], "left_semi")
        found = durable(_middle(_weights(level, keys, draws, seed, needed is None), needed, keys, draws, least, shift == 0, prob), "boot-middle")
        spent.append(found)
        needed = found
    discard(placed)
    for t in spent[:-1]:
        discard(t)
    return needed.join(values.select("pos", "v"), needed.parent == F.col("pos")).groupBy(*keys, "draw").agg(F.sum(F.col("v") * F.col("share")).alias("m"))


def _weights(level: DataFrame, keys: list[str], draws: int, seed: int, totals: bool) -> DataFrame:
    """(keys..., parent, sub, w): all draws' weights of the rows in a range of values, a row per range and task;
    with `totals` also those of the whole cell, as sub -1."""
    by = [*keys, "parent", "sub"]
    held = _by_range(level)
    schema = held.select(*by, F.array(F.lit(0).cast("long")).alias("w")).schema

    def run(batches):
        kinds: list = []

        def out(cells):
            n = len(cells.at)
            columns = [pa.array([k[i] for k in cells.at], kinds[i]) for i in range(len(by))]
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * draws)
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(cells.sums[0, :n].ravel()))], [*by, "w"])

        cells = _Cells(1, draws, np.int64)
        for b, at, w in _weighted(batches, draws, seed):
            kinds = kinds or [b.schema.field(k).type for k in by]
            part = b.slice(at.start, at.stop - at.start)
            own = list(zip(*(part.column(k).to_pylist() for k in by), strict=True))
            c = [part.column("c").to_numpy()]
            cells.add(own, c, w)
            if totals:
                cells.add([(*k[:-1], -1) for k in own], c, w)
            if cells.full():
                yield out(cells)
                cells = _Cells(1, draws, np.int64)
        if cells.at:
            yield out(cells)

    return held.mapInArrow(run, schema)


def _middle(weights: DataFrame, needed: DataFrame | None, keys: list[str], draws: int, least: int, last: bool, prob: float) -> DataFrame:
    """Which range of values holds the two rows of each draw that its quantile lies between (one and the same if it lies on a row).

    Ranges of a parent come in order, after what is looked for in it. (keys..., parent, lo, hi, part): the range, and per draw how many rows of it
    stand before the two, -1 for draws that look elsewhere, and the upper one's share; at the last level (keys..., draw, parent, share), two rows a draw."""
    none, real = F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<double>")
    both = weights.withColumn("lo", none).withColumn("hi", none).withColumn("part", real)
    if needed is not None:
        both = both.unionByName(needed.withColumn("sub", F.lit(-1).cast("long")).withColumn("w", none))
    both = both.repartition(*keys, "parent").sortWithinPartitions(*keys, "parent", "sub")
    start = weights.select(*keys)
    long = F.lit(0).cast("long")
    if last:
        schema = start.withColumn("draw", long).withColumn("parent", long).withColumn("share", F.lit(0.0)).schema
    else:
        schema = start.withColumn("parent", long).withColumn("lo", none).withColumn("hi", none).withColumn("part", real).schema
    names, first = [f.name for f in schema], needed is None

    def run(batches):
        kinds: list = []
        cell = sub = sought = part = before = now = None

        def hit():
            """Closes a range: rows of the result if a middle is in it."""
            nonlocal before
            inside = [(s >= before) & (s < before + now) & (s >= 0) for s in sought]
            if any(x.any() for x in inside):
                if last:
                    draw = np.concatenate([np.flatnonzero(x) for x in inside]) + 1
                    columns = [pa.array([k] * len(draw), t) for k, t in zip(cell[:-1], kinds, strict=False)]
                    share = np.concatenate([(1 - part)[inside[0]], part[inside[1]]])
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(draw, pa.int64()), pa.array(np.full(len(draw), sub)), pa.array(share)], names)
                else:
                    columns = [pa.array([k], t) for k, t in zip(cell[:-1], kinds, strict=False)]
                    rest = [pa.array([np.where(x, s - before, -1)], pa.list_(pa.int64())) for x, s in zip(inside, sought, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([sub], pa.int64()), *rest, pa.array([part], pa.list_(pa.float64()))], names)
            before = before + now

        for b in batches:
            kinds = kinds or [b.schema.field(k).type for k in keys]
            columns = [b.column(k).to_pylist() for k in (*keys, "parent", "sub")]
            for i, k in enumerate(zip(*columns, strict=True)):
                if k[:-1] != cell or k[-1] != sub:
                    if sub is not None and sub >= 0:
                        yield from hit()
                    if k[:-1] != cell:
                        before, sought, total = np.zeros(draws, np.int64), None, np.zeros(draws, np.int64)
                    cell, sub, now = k[:-1], k[-1], np.zeros(draws, np.int64)
                if sub < 0 and first:
                    total = total + b.column("w")[i].values.to_numpy()
                    place = prob * (total - 1)
                    sought = [np.where(total >= least, x, -1).astype(np.int64) for x in (np.floor(place), np.ceil(place))]
                    part = place - np.floor(place)
                elif sub < 0:
                    sought = [b.column(x)[i].values.to_numpy() for x in ("lo", "hi")]
                    part = b.column("part")[i].values.to_numpy()
                else:
                    now = now + b.column("w")[i].values.to_numpy()
        if sub is not None and sub >= 0:
            yield from hit()

    return both.mapInArrow(run, schema)


def _interval(stats: DataFrame, col: str, alpha: float, by: list[str]) -> DataFrame:
    edges = F.percentile(col, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return stats.groupBy(*by).agg(edges.alias("_e"), F.avg((F.col(col) <= 0).cast("double")).alias("share_le_0")).select(*by, F.col("_e")[0].alias("lo"), F.col("_e")[1].alias("hi"), "share_le_0")


def _stat(stat: str, value: str) -> Column:
    if stat == "median":
        return F.percentile(value, 0.5)
    return F.avg(value)


def _collapsed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group and value, with `c`, how often it stands."""
    return rows.groupBy(*keys, "grp", "v").agg(F.count("*").alias("c"))


def cluster_bootstrap(df: DataFrame, value: str, group: str, stat: str = "median", draws: int = 200, seed: int = 0, alpha: float = 0.05, prob: float = 0.5) -> DataFrame:
    """One row (obs, lo, hi). Nulls are dropped first; an empty table gives nulls. A rate is the share of values other than zero, a quantile the one at `prob`."""
    if stat not in ("mean", "median", "rate", "quantile"):
        raise ValueError(f"stat must be 'mean', 'median', 'rate' or 'quantile', not {stat!r}")
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col(value).cast("double").alias("v"))
    if stat == "rate":
        rows, stat = rows.withColumn("v", (F.col("v") != 0).cast("double")), "mean"
    rows = durable(rows, "boot")
    own = indexed(rows, "grp")
    if stat == "mean":
        sums = rows.groupBy("grp").agg(F.sum("v").alias("s"), F.count("*").alias("c"))
        stats = _sums(sums, own, [], ["s", "c"], draws, seed).where("c > 0").select("draw", (F.col("s") / F.col("c")).alias("stat"))
    else:
        prob = 0.5 if stat == "median" else prob
        stats = _medians(_collapsed(rows, []), own, [], draws, seed, prob=prob).withColumnRenamed("m", "stat")
    obs = rows.agg((F.percentile("v", prob) if stat == "quantile" else _stat(stat, "v")).alias("obs"))
    return settled(obs.crossJoin(F.broadcast(_interval(stats, "stat", alpha, []))), rows, own)  # one row each


def cluster_boot_diff(df: DataFrame, value: str, group: str, side: str, stat: str = "median", draws: int = 200, seed: int = 0, alpha: float = 0.05, by: list[str] | None = None, min_side: int = 1) -> DataFrame:
    """(by..., obs, lo, hi, share_le_0, n_a, n_b, tied): side 'a' minus side 'b', both sides from
    one draw over the union of their groups (per `by`, the union of all its rows' groups).

    Missing values are dropped; draws with fewer than min_side rows on a side are discarded; `tied` says that the interval is
    the single point zero, which looks precise and is not. All cells of `by` share the draws."""
    by = by or []
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & F.col(side).isin("a", "b") & F.col(group).isNotNull()).select(*by, F.col(group).alias("grp"), F.col(side).alias("side"), v.alias("v"))
    rows = durable(rows, "boot")
    own = indexed(rows, "grp")
    of = lambda s, c: F.when(F.col("side") == s, F.col(c))
    if stat == "mean":
        sums = rows.groupBy(*by, "grp").agg(*(F.coalesce(F.sum(of(s, "v")), F.lit(0.0)).alias(f"s{s}") for s in "ab"), *(F.count(of(s, "v")).alias(f"c{s}") for s in "ab"))
        per = _sums(sums, own, by, ["sa", "sb", "ca", "cb"], draws, seed)
        stats = per.where(f"ca >= {min_side} and cb >= {min_side}").select(*by, "draw", (F.col("sa") / F.col("ca") - F.col("sb") / F.col("cb")).alias("stat"))
        obs = rows.groupBy(*by).agg((F.avg(of("a", "v")) - F.avg(of("b", "v"))).alias("obs"), F.count(of("a", "v")).alias("n_a"), F.count(of("b", "v")).alias("n_b"))
    else:
        per = _medians(_collapsed(rows, [*by, "side"]), own, [*by, "side"], draws, seed, max(1, min_side))
        stats = per.groupBy(*by, "draw").agg(F.max(of("a", "m")).alias("ma"), F.max(of("b", "m")).alias("mb")).select(*by, "draw", (F.col("ma") - F.col("mb")).alias("stat")).where("stat is not null")
        obs = rows.groupBy(*by).agg((F.percentile(of("a", "v"), 0.5) - F.percentile(of("b", "v"), 0.5)).alias("obs"), F.count(of("a", "v")).alias("n_a"), F.count(of("b", "v")).alias("n_b"))
    edges = _interval(stats, "stat", alpha, by)
    out = obs.join(edges, by, "left") if by else obs.crossJoin(F.broadcast(edges))  # one row each
    return settled(out.select(*by, "obs", "lo", "hi", "share_le_0", "n_a", "n_b", F.expr("coalesce(obs = 0 and lo = 0 and hi = 0, false)").alias("tied")), rows, own)


def extremes_vs_middle(df: DataFrame, bin_col: str, outcome: str, group: str, extremes: tuple[int, int] = (1, 5), middle: int = 3, draws: int = 200, seed: int = 0) -> DataFrame:
    """The outer bins' mean outcome minus the middle one's; draws with under 2 rows on a side are dropped."""
    side = F.when(F.col(bin_col).isin(*extremes), "a").when(F.col(bin_col) == middle, "b")
    return cluster_boot_diff(df.withColumn("_side", side), outcome, group, "_side", "mean", draws, seed, min_side=2)


def boot_ratio(num: DataFrame, den: DataFrame, value: str, group: str, stat: str = "median", draws: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row (obs, lo, hi): stat(num) / stat(den) with one draw for both; den may hold several cells a row."""
    both = num.select(F.col(group).alias("grp"), F.col(value).cast("double").alias("v"), F.lit("a").alias("side")).unionByName(den.select(F.col(group).alias("grp"), F.col(value).cast("double").alias("v"), F.lit("b").alias("side"))).where("v is not null and grp is not null")
    both = durable(both, "boot")
    own = indexed(both, "grp")
    if stat == "median":
        per = _medians(_collapsed(both, ["side"]), own, ["side"], draws, seed)
    else:
        sums = both.groupBy("side", "grp").agg(F.sum("v").alias("s"), F.count("*").alias("c"))
        per = _sums(sums, own, ["side"], ["s", "c"], draws, seed).where("c > 0").select("draw", "side", (F.col("s") / F.col("c")).alias("m"))
    stats = per.groupBy("draw").agg(F.try_divide(F.max(F.when(F.col("side") == "a", F.col("m"))), F.max(F.when(F.col("side") == "b", F.col("m")))).alias("stat")).where("stat is not null")
    obs = both.groupBy("side").agg(_stat(stat, "v").alias("m")).agg(F.try_divide(F.max(F.when(F.col("side") == "a", F.col("m"))), F.max(F.when(F.col("side") == "b", F.col("m")))).alias("obs"))
    return settled(obs.crossJoin(F.broadcast(_interval(stats, "stat", alpha, []))).drop("share_le_0"), both, own)  # one row each


def additive_bootstrap(df: DataFrame, parts: dict[str, Column], group: str, finish: Column, draws: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row (obs, lo, hi) of any statistic of sums: `parts` are columns that are added up over a draw's rows, `finish` makes the
    statistic of their sums, by name. So blocks add up in the tasks and merge by addition, for all draws at once: trimmed and
    winsorised means, moments, slopes, shares and counts on a grid. Missing parts count as zero."""
    own_names = [f"_part{i}" for i in range(len(parts))]  # callers' names may be any
    rows = durable(df.where(F.col(group).isNotNull()).select(F.col(group).alias("grp"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in zip(own_names, parts.values(), strict=True))), "boot")
    own = indexed(rows, "grp")
    sums = rows.groupBy("grp").agg(*(F.sum(k).alias(k) for k in own_names))
    named = [F.col(k).alias(name) for k, name in zip(own_names, parts, strict=True)]
    stats = _sums(sums, own, [], own_names, draws, seed).select(*named).select(finish.alias("stat")).where("stat is not null")
    obs = rows.agg(*(F.sum(k).alias(k) for k in own_names)).select(*named).select(finish.alias("obs"))
    return settled(obs.crossJoin(F.broadcast(_interval(stats, "stat", alpha, []))).drop("share_le_0"), rows, own)  # one row each


def custom_bootstrap(df: DataFrame, value: str, group: str, stat, draws: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row (obs, lo, hi) for any function of a numpy array. Each draw's rows come together in one
    task, so this is for tables of which one task can hold a column; quantiles and statistics of sums have jobs of their own above."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("grp"), F.col(value).cast("double").alias("v"))
    m = multiplicities(rows, "grp", draws, seed)
    drawn = rows.join(m, "grp").select("draw", "v", "w").unionByName(rows.select(F.lit(0).cast("long").alias("draw"), "v", F.lit(1).cast("long").alias("w")))

    def one(table: pa.Table) -> pa.Table:
        v = np.repeat(table.column("v").to_numpy(), table.column("w").to_numpy())
        return pa.table({"draw": [table.column("draw")[0].as_py()], "stat": [float(stat(np.sort(v)))]})

    stats = drawn.groupBy("draw").applyInArrow(one, "draw long, stat double")
    obs = stats.where("draw = 0").agg(F.max("stat").alias("obs"))
    return obs.crossJoin(F.broadcast(_interval(stats.where("draw > 0"), "stat", alpha, []))).drop("share_le_0")  # one row each
