"""Two-pass external shuffle into shards.

Pass one scatters rows by seeded hashes: a rendezvous hash of the id picks the shard (so one
more shard takes rows only into itself), and a hash of id and text picks a bucket of the shard
that fits in memory. Pass two shuffles each bucket by Fisher-Yates under a seed of its own. The
order within a shard is bucket after bucket. Nothing depends on the order in which rows arrive.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, read

SEED = 20_011
#: Bytes of rows a bucket should hold, on average.
BUCKET_BYTES = 8 << 20
#: Buckets whose first slots (a few bytes each) are broadcast at most.
MOST_BROADCAST = 200_000
BUCKETS_A_TASK = 8


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is largest. Null keys share a shard."""
    return F.greatest(*(F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)))["s"]


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    order = np.arange(n)
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)), strict=True):
        order[i], order[j] = order[j], order[i]
    return order


def shuffle_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with `shard` (0 to shards - 1) and `slot` (its place in the shard, gapless from 0).

    If docs has columns of these names, they are replaced. Rows with a null id go to one shard
    and spread over its buckets by text; equal rows take neighbouring ranks in either order, so
    the result is the same. An empty table gives no rows. Texts are shuffled once: the buckets'
    first slots are joined on before the scatter, as a broadcast while they are few, and else by
    a join on the very keys that the scatter needs.
    """
    docs = docs.drop("shard", "slot")
    bucket, mark, first = fresh(docs, "bucket", "mark", "first_slot")
    total = docs.agg(F.sum(size_of(F.col(text)) + 64)).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    keyed = docs.select("*", shard_of(F.col(id_col), shards, seed).alias("shard"), F.xxhash64(text).alias(mark))
    keyed = keyed.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed + 1), id_col, mark), F.lit(per_shard)).cast("int"))
    counts = keyed.groupBy("shard", bucket).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", bucket, before.alias(first))
    carried = [c for c in docs.columns]

    def shuffle(table: pa.Table) -> pa.Table:
        where = table.column("shard")[0].as_py(), table.column(bucket)[0].as_py()
        slots = np.arange(len(table)) + table.column(first)[0].as_py()
        rest = [c for c in carried if c not in (id_col, text) and not pa.types.is_nested(table.schema.field(c).type)]
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in (id_col, mark, *rest)]))
        order = _fisher_yates(len(table), np.random.default_rng([seed, *where]))
        return table.select([*carried, "shard"]).take(pa.array(order)).append_column("slot", pa.array(slots))

    schema = keyed.select(*carried, "shard").schema.add("slot", "long")
    # so many partitions that each holds a few buckets, whatever the session's setting
    buckets, usual = shards * per_shard, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df: df.repartition(min(buckets, max(usual, buckets // BUCKETS_A_TASK)), "shard", bucket)
    placed = deal(keyed).join(F.broadcast(offsets) if buckets <= MOST_BROADCAST else deal(offsets), ["shard", bucket])
    return placed.groupBy("shard", bucket).applyInArrow(shuffle, schema)


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Write each shard's rows in slot order under path/shard=N."""
    out = shuffle_shards(docs, shards, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """Contract digest under the `key` law, taken from the shuffled documents."""
    docs = read(spark, sf_dir, "documents")
    out = shuffle_shards(docs.select("doc_id", "text"), shards)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return out.select("doc_id", size_of(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
