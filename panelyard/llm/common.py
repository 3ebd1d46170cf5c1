"""Steps that the corpus operators share: reading, durable cuts of lineage, Arrow helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: \x20 and \x09-\x0D, which is also what bytes.split() uses.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Set here only where the session has none, and then only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
    return made.get()


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, so that later steps neither
    recompute it nor depend on an executor that may be lost."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def erase(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own in the shared one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table of durable() that nothing reads any more."""
    erase(df.sparkSession, df.written_to)


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Delete tables of durable() that nothing reads any more, and let Spark drop the shuffle files of
    finished plans: its cleaner follows the driver's garbage collection, which by itself may be long in coming."""
    for df in done:
        discard(df)
    gc.collect()
    spark._jvm.System.gc()


def raw(batch: pa.RecordBatch, column: str) -> list:
    """A string column as UTF-8 bytes (None for null)."""
    return batch.column(column).cast(pa.binary()).to_pylist()


#: Bytes of an Arrow batch: small enough for tables with very long texts, large enough for narrow rows.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as all operators here want them. The session keeps the setting, since it
    is read when a plan runs; its number of rows a batch, and a smaller bound, stay as they were."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.fullmatch("([0-9]+)b?", spark.conf.get(name))
    if not held or not 0 < int(held[1]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Bits of a bitmap of keys, as powers of two: at least, and at most, which bounds what is broadcast to
#: 128 MB; in between, eight or more a key.
LEAST_BITS, MOST_BITS = 25, 30


def bitmap(keys: DataFrame):
    """A broadcast bitmap of a column of 64-bit hashes. It lets through all of them and, up to 130 million
    keys, few others, so that an exact join after it shuffles little; its size is bounded."""
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (8 * keys.count()).bit_length()))
    at = F.pmod(F.col(keys.columns[0]), F.lit(bits)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    held = bytearray(bits >> 3)
    for r in parts.toLocalIterator():  # 4 kB each
        held[(r.part - 1) << 12 : r.part << 12] = r.bits
    return keys.sparkSession.sparkContext.broadcast(bytes(held))


def among(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a bitmap."""
    bit = keys & ((len(mask) << 3) - 1)  # its size is a power of two
    return (mask[bit >> 3] >> (bit & 7) & 1).astype(bool)


def passing(rows: DataFrame, col: str, sent) -> DataFrame:
    """The rows whose hash may be in the bitmap."""
    at = rows.columns.index(col)

    def run(batches):
        mask = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            yield b.filter(pa.array(among(mask, b.column(at).to_numpy(zero_copy_only=False))))

    return rows.mapInArrow(run, rows.schema)


def ascii_lower(c):
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that clash with none of df's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
