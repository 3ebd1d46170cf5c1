"""The least value of each group, beside every row, with no task that holds a hot group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh


def with_least(rows: DataFrame, keys: list[str], value: Column, spread: Column, out: str) -> DataFrame:
    """rows plus column `out`: the least non-null `value` of the rows that agree in all keys (nulls agree).

    `spread` deals a group's rows over as many parts as the session has shuffle partitions: it must not
    depend on the keys alone. Each part finds its own least, parts agree on one (a group has at most as
    many rows there as there are parts), and rows fetch it by keys and part, so that a key that holds a
    third of all rows is shared by all tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, own = fresh(rows, "_part", "_own")
    rows = rows.withColumn(part, F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    parts = rows.groupBy(*keys, part).agg(F.min(value).alias(own))
    whole = parts.groupBy(*keys).agg(F.min(own).alias(out))

    def joined(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        b = b.select(*(F.col(k).alias(f"_{i}_of_b") for i, k in enumerate(on)), out)
        same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{i}_of_b")) for i, k in enumerate(on)))
        return a.join(b, same).drop(*(f"_{i}_of_b" for i in range(len(on))))

    return joined(rows, joined(parts, whole, keys), [*keys, part]).drop(part)
