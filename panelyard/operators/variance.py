"""Shares of explained variance over blocks of columns.

One aggregate makes the cross-product matrix of all columns; its size depends on the number of
columns, not of rows. The small least-squares solves over it are plain numpy on the driver.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import average_ranked, quantiles


def gram(df: DataFrame, cols: list[str], weight: str | None = None) -> np.ndarray:
    """Cross products of (1, cols...) over rows without missing values."""
    full = df.select(*(F.col(c).cast("double").alias(c) for c in cols), *([weight] if weight else [])).dropna()
    x = [F.lit(1.0), *(F.col(c) for c in cols)]
    w = F.col(weight) if weight else F.lit(1.0)
    row = full.agg(*(F.sum(w * x[i] * x[j]).alias(f"g{i}_{j}") for i in range(len(x)) for j in range(i + 1))).first()
    out = np.zeros((len(x), len(x)))
    for i in range(len(x)):
        for j in range(i + 1):
            out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


def r2_of(g: np.ndarray, y: int, columns: list[int]) -> float:
    """R squared of column y on an intercept and columns of a cross-product matrix."""
    n, use = g[0, 0], [0, *columns]
    total = g[y, y] - g[0, y] ** 2 / n if n else 0.0
    if total <= 0:
        return float("nan")
    beta = np.linalg.lstsq(g[np.ix_(use, use)], g[use, y], rcond=None)[0]
    return float((beta @ g[use, y] - g[0, y] ** 2 / n) / total)


def r2_lattice(df: DataFrame, y: str, blocks: dict[str, list[str]], max_blocks: int = 12) -> dict[frozenset, float]:
    """R squared of every subset of blocks; refuses more than max_blocks."""
    if len(blocks) > max_blocks:
        raise ValueError(f"{len(blocks)} blocks make {2 ** len(blocks)} fits; the limit is {max_blocks} blocks")
    cols = [y, *dict.fromkeys(c for own in blocks.values() for c in own)]
    g, at = gram(df, cols), {c: k + 1 for k, c in enumerate(cols)}
    return {frozenset(s): r2_of(g, 1, sorted({at[c] for b in s for c in blocks[b]})) for k in range(len(blocks) + 1) for s in combinations(blocks, k)}


def shapley(r2: dict[frozenset, float], order: list[str]) -> list[dict]:
    """Per block: alone, least and largest increment, Shapley value, and its increment in the given order."""
    out, n = [], len(order)
    for k, b in enumerate(order):
        gains = {s: r2[s | {b}] - r2[s] for s in r2 if b not in s}
        value = sum(factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n) * v for s, v in gains.items())
        out.append({"block": b, "alone": r2[frozenset([b])], "min_increment": min(gains.values()), "max_increment": max(gains.values()), "shapley": value, "in_order": r2[frozenset(order[: k + 1])] - r2[frozenset(order[:k])]})
    return out


def shapley_table(df: DataFrame, y: str, blocks: dict[str, list[str]]) -> DataFrame:
    """The Shapley rows as a DataFrame: one row per block."""
    rows = shapley(r2_lattice(df, y, blocks), list(blocks))
    return df.sparkSession.createDataFrame([tuple(float(v) if not isinstance(v, str) else v for v in r.values()) for r in rows], "block string, alone double, min_increment double, max_increment double, shapley double, in_order double")


def winsorise(df: DataFrame, cols: list[str], by: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Columns clipped to their cohort's quantiles, missing ones filled with the cohort's median, `_missing` flags."""
    out = df
    for c in cols:
        out = out.join(quantiles(df, c, by, [low, 0.5, high], f"_e_{c}"), by, "left")
    for c in cols:
        e = F.col(f"_e_{c}")
        out = out.withColumn(f"{c}_missing", F.col(c).isNull()).withColumn(c, F.when(F.col(c).isNull(), e[1]).otherwise(F.least(F.greatest(F.col(c), e[0]), e[2])))
    return out.drop(*(f"_e_{c}" for c in cols))


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Spearman correlation within each frame: Pearson of average ranks."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = average_ranked(average_ranked(rows, by, a, "_a"), by, b, "_b")
    return rows.groupBy(*by).agg(F.corr("_a", "_b").alias("rho"), F.count("*").alias("n"))


def firm_grams(df: DataFrame, cols: list[str], group: str) -> DataFrame:
    """(grp, g_i_j...): each firm's own cross products of (1, cols...), one row a firm."""
    full = df.select(F.col(group).alias("grp"), *(F.col(c).cast("double").alias(c) for c in cols)).dropna()
    x = [F.lit(1.0), *(F.col(c) for c in cols)]
    return full.groupBy("grp").agg(*(F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(len(x)) for j in range(i + 1)))


def shapley_bootstrap(df: DataFrame, y: str, blocks: dict[str, list[str]], group: str, draws: int = 100, seed: int = 0, max_blocks: int = 8) -> DataFrame:
    """(draw, block, shapley), draw 0 on the data as it is. Firms are drawn whole: their cross
    products are reweighted, so the rows are read once whatever the number of draws. What comes
    to the driver is one small matrix a draw."""
    from .resample import _sums, indexed

    if len(blocks) > max_blocks:
        raise ValueError(f"{len(blocks)} blocks; the limit here is {max_blocks}")
    cols = [y, *dict.fromkeys(c for own in blocks.values() for c in own)]
    grams, at = firm_grams(df, cols, group), {c: k + 1 for k, c in enumerate(cols)}
    names = [c for c in grams.columns if c != "grp"]
    base = grams.agg(*(F.sum(c).alias(c) for c in names)).select(F.lit(0).cast("long").alias("draw"), *names)
    drawn = _sums(grams, indexed(grams, "grp"), [], names, draws, seed)
    rows = []
    for r in base.unionByName(drawn).collect():
        g = np.zeros((len(cols) + 1,) * 2)
        for c in names:
            i, j = map(int, c[1:].split("_"))
            g[i, j] = g[j, i] = r[c] or 0.0
        r2 = {frozenset(s): r2_of(g, 1, sorted({at[c] for b in s for c in blocks[b]})) for k in range(len(blocks) + 1) for s in combinations(blocks, k)}
        rows += [(r.draw, x["block"], float(x["shapley"])) for x in shapley(r2, list(blocks))]
    return df.sparkSession.createDataFrame(rows, "draw long, block string, shapley double")


def cluster_logit(df: DataFrame, y: str, cols: list[str], cluster: str, steps: int = 25, tolerance: float = 1e-10) -> DataFrame:
    """(term, coefficient, clustered_se) of a logit with an intercept, errors clustered by firm.

    Newton steps: each is one aggregate of the score and the information matrix, whose size
    depends on the number of columns. The sandwich takes one more pass, by firm."""
    full = df.select(F.col(y).cast("double").alias("_y"), F.col(cluster).alias("_g"), *(F.col(c).cast("double").alias(c) for c in cols)).dropna()
    x = [F.lit(1.0), *(F.col(c) for c in cols)]
    k, beta = len(x), np.zeros(len(cols) + 1)

    def parts(beta):
        z = sum((F.lit(float(b)) * c for b, c in zip(beta[1:], x[1:], strict=True)), F.lit(float(beta[0])))
        p = 1 / (1 + F.exp(-z))
        return p, p * (1 - p)

    for _ in range(steps):
        p, w = parts(beta)
        r = full.agg(*(F.sum((F.col("_y") - p) * c).alias(f"s{i}") for i, c in enumerate(x)), *(F.sum(w * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i + 1))).first()
        score, info = np.array([r[f"s{i}"] for i in range(k)]), np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1):
                info[i, j] = info[j, i] = r[f"h{i}_{j}"]
        move = np.linalg.lstsq(info, score, rcond=None)[0]
        beta = beta + move
        if np.abs(move).max() < tolerance:
            break
    p, _w = parts(beta)
    own = full.groupBy("_g").agg(*(F.sum((F.col("_y") - p) * c).alias(f"s{i}") for i, c in enumerate(x)))
    r = own.agg(*(F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i + 1))).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            meat[i, j] = meat[j, i] = r[f"m{i}_{j}"]
    bread = np.linalg.pinv(info)
    se = np.sqrt(np.diag(bread @ meat @ bread))
    return df.sparkSession.createDataFrame([(t, float(b), float(s)) for t, b, s in zip(["intercept", *cols], beta, se, strict=True)], "term string, coefficient double, clustered_se double")
