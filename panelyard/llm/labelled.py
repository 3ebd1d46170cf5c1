"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(of))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id_col: str, text: str, per_class: int, max_bytes: int):
    """At most per_class rows of each label among the rows to learn from, as (texts, 0/1 labels, share of label 1).

    Texts over max_bytes are not learned from (they are scored like any other), nor are missing
    ones; rows are chosen among the others by a hash of their id, so neither shrinks the sample. A
    label that is null or neither 0 nor 1, and a row without an id, is no label; an id with several
    labels counts as 1 if one of them is 1. The share is over all rows to learn from.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & learn).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    rows = docs.where(F.octet_length(text) <= max_bytes).select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    usable = durable(rows.select("id").join(known, "id").distinct(), "labelled")
    picked = []
    for y in (0, 1):
        ids = usable.where(F.col("y") == y).select("id").orderBy(F.xxhash64("id"), "id").limit(per_class)
        own = rows.join(F.broadcast(ids), "id").orderBy(F.xxhash64("id"), "id", "t").limit(per_class)
        picked += [(r.t, y) for r in own.select("t").toLocalIterator()]
    return [t.encode() for t, _ in picked], [y for _, y in picked], 0.5 if share is None else float(share)


def restored(cls, state: dict):
    """A model from its attributes; these alone are broadcast, so executors need no package of ours."""
    out = cls.__new__(cls)
    out.__dict__.update(state)
    return out
