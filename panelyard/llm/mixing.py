"""Mixing sources to target weights by balanced sampling (the cube method).

A source's target is a multiple r of its words. Every document of it is taken floor(r) times,
and once more with probability r - floor(r). The extra copies are drawn by the cube method:
within blocks of documents the vector of probabilities walks through the null space of the
constraints (number of documents, number of words) until all but two of the block's
probabilities are 0 or 1. The two that are left of each block form new blocks, level by level,
until one block a source is left. Its flight spares a dozen documents; landing tries all ways to
round these and the last two, and takes the one that brings words and documents nearest to target. Totals of documents and words are kept at every step, up to that landing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, fresh, read

SEED, CAP, BLOCK = 30_011, 3.0, 2000
#: Documents a source that its last flight leaves for landing.
SPARED = 12
#: Weights of the sources by code point, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
_EPS = 1e-9


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, size) of documents -> (source, source_size, n_docs, target).

    Targets share the total by weight; none is above cap times its source's size, and what a
    source leaves goes to the others by weight. Resharing ends at a common level L with target
    = min(L x weight, cap x size); L is found from running sums over sources in order of
    cap x size / weight, the order in which they fill up.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("full", cap * F.col("source_size") / F.col("w"))
    below = Window.orderBy("full", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    per = per.withColumn("left_size", F.sum("source_size").over(everyone) - cap * F.coalesce(F.sum("source_size").over(below), F.lit(0)))
    per = per.withColumn("left_w", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    per = per.withColumn("level", F.col("left_size") / F.col("left_w"))
    # these levels rise while their sources fill up and fall from then on: the highest is the one that holds
    level = F.max("level").over(everyone)
    target = F.least(level * F.col("w"), cap * F.col("source_size").cast("double"))
    return per.select("source", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def _flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, spared: int = 0) -> np.ndarray:
    """Probabilities after the flight: at most two are left strictly between 0 and 1, besides the spared.

    Three units at a time: with constraint rows (1, 1, 1) and their sizes, the null space is
    the cross product of the rows; where the sizes are equal any exchange of two keeps both."""
    p = p.copy()
    open_ = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS][::-1][spared:]
    draws = iter(rng.random(len(open_) + 3))
    held = []
    while True:
        while len(held) < 3 and open_:
            held.append(open_.pop())
        if len(held) < 3:
            break
        a, b, c = (float(size[i]) for i in held)
        u = (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0)
        x = [float(p[i]) for i in held]
        up = min((1 - v) / d if d > 0 else v / -d for v, d in zip(x, u, strict=True) if d)
        down = min(v / d if d > 0 else (1 - v) / -d for v, d in zip(x, u, strict=True) if d)
        step = up if next(draws) < down / (up + down) else -down
        x = [v + step * d for v, d in zip(x, u, strict=True)]
        x = [0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v for v in x]
        for i, v in zip(held, x, strict=True):
            p[i] = v
        held = [i for i in held if 0 < p[i] < 1]
    return p


def _landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the open probabilities: of all ways, the one nearest in words (in mean sizes), then in documents."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    ways = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(ways @ size[open_] - p[open_] @ size[open_]) / max(1.0, float(size.mean()))
    best = ways[np.argmin(words + 0.01 * np.abs(ways.sum(axis=1) - p[open_].sum()))]
    p = p.copy()
    p[open_] = best
    return p


def mix(docs: DataFrame, size: Column, source: str = "source", seed: int = SEED, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """docs with `size`, `source_size`, `target` (its source's) and `copies`, how often the mix takes the row.

    Columns of docs with these names are replaced. A null source is a source of its own, last
    in order. Documents without words are never taken (0 copies). Equal rows are drawn on
    their own; which of them is taken makes no difference. Sizes all equal, one document in a
    source and empty tables are fine. The draw depends on the rows and the seed alone.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    docs = docs.select(*(c for c in names), size.alias("size"))
    p, more, key, group, own, extra = fresh(docs, "p", "whole", "unit_key", "block_no", "own_source", "extra")
    per = durable(targets(docs.select(F.col(source).alias("source"), "size"), weights, cap), "mix-targets")
    largest = per.agg(F.max("n_docs")).first()[0] or 0
    ratio = F.least(F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)), F.lit(cap))
    whole = F.floor(ratio + F.lit(_EPS))
    per = per.withColumn(more, whole.cast("int")).withColumn(p, F.greatest(ratio - whole, F.lit(0.0))).withColumnRenamed("source", own)
    sized = docs.join(F.broadcast(per) if per.count() <= 100_000 else per, F.col(source).eqNullSafe(F.col(own))).drop(own)
    sized = sized.withColumn(p, F.when((F.col("size") == 0) | (F.col(p) < _EPS), 0.0).otherwise(F.col(p)))
    flat = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant", "array", "struct")]
    sized = sized.withColumn(key, F.xxhash64(F.lit(seed), *flat))
    # the flight needs a row's source, size and probability; what else it holds stays where it is
    units = sized.select(source, "size", "n_docs", p, key)
    schema = units.withColumn(group, F.lit(0).cast("int")).schema
    # blocks of a source by hash; at each next level two units of each block are left at most
    sizes, done, open_, level = [], [], units, 0
    n = largest
    while True:
        sizes.append(max(1, -(-n // block)))
        if sizes[-1] == 1:
            break
        n = 2 * sizes[-1]

    def step(level: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            table = table.take(pc.sort_indices(table, sort_keys=[(key, "ascending"), ("size", "ascending")]))
            name = table.column(source)[0].as_py()
            rng = np.random.default_rng([seed, level, table.column(group)[0].as_py(), *(str(name).encode() if name is not None else b"\xff\xff")])
            size, start = table.column("size").to_numpy(), table.column(p).to_numpy()
            end = _flight(start, size, rng, SPARED * last)
            if last:
                end = _landing(end, size)
            return table.set_column(table.schema.get_field_index(p), p, pa.array(end))

        return run

    for level, blocks in enumerate(sizes):
        share = F.ceil(F.col("n_docs") * blocks / F.lit(max(1, largest))) if level == 0 else F.lit(blocks)
        dealt = open_.withColumn(group, F.pmod(F.xxhash64(F.lit(level), key), share).cast("int"))
        out = durable(dealt.groupBy(source, group).applyInArrow(step(level, level == len(sizes) - 1), schema).drop(group), f"mix-{level}")
        done.append(out.where(f"`{p}` = 0 or `{p}` = 1"))
        open_ = out.where(f"`{p}` > 0 and `{p}` < 1")
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    # rows with one key are equal: as many of them as the flight took have a copy more
    taken = result.groupBy(key).agg(F.sum(p).cast("int").alias(extra))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(key))
    out = sized.join(taken, key).withColumn(extra, (rank <= F.col(extra)).cast("int"))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col(more) + F.col(extra)).cast("int")
    return out.select(*names, "size", "source_size", "target", copies.alias("copies"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: taken counts the words that the mix takes, repeats counted."""
    docs = read(spark, sf_dir, "documents")
    out = mix(docs.select("doc_id", "source", words_of(F.col("text")).alias("n")), F.col("n")).drop("n")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
