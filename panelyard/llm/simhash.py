"""SimHash near-duplicates: fingerprints of word shingles, exact links within a Hamming
distance by anchor points of a covering code, and connected components.

The anchors. Two 64-bit fingerprints that differ in at most 3 bits differ in at most 1 bit on
one of their 32-bit halves. On 31 bits of a half the anchors are the words of the perfect
[31, 26] Hamming code, whose covering radius is 1: each fingerprint has an anchor within 1, and
its partner lies within 1 + 1 = 2 of the same anchor. So every fingerprint is replicated to all
anchors within 2 (1 or 16 of 67 million for each half), and pairs are compared per anchor on all
64 bits. No link is missed, and no link is found that is not there.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fresh, raw, read, small_batches
from .components import components

BITS, THRESHOLD, SEED = 64, 3, 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Up to this size an anchor's fingerprints are compared by shifting; larger groups by blocks.
SMALL_GROUP, BLOCK = 48, 1024

_U = np.uint64
_PART = np.arange(1 << 16, dtype=np.uint32)


def _syndromes(shift: int) -> np.ndarray:
    out = np.zeros(1 << 16, np.uint8)
    for bit in range(16):
        if bit + shift < 31:
            out ^= (((_PART >> bit) & 1) * (bit + shift + 1)).astype(np.uint8)
    return out


_LOW, _HIGH = _syndromes(0), _syndromes(16)
#: For each syndrome: the flips of one or two bits that lead to a code word.
_FLIPS = [np.array([0] if s == 0 else [1 << (s - 1)] + [1 << (i - 1) | 1 << (j - 1) for i in range(1, 32) if i < (j := i ^ s)], np.uint64) for s in range(32)]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles as a signed 64-bit number; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, last = [0, *ends], min(shingle, len(words)) - 1
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(joined[starts[i] : ends[i + last] - 1], SEED) for i in range(k, min(n, k + CHUNK))]) for k in range(0, n, CHUNK))


def majority(parts) -> int:
    """The bits that are set in over half of the hashes, which come in parts of 8 bytes a hash, high byte first."""
    counts, n = np.zeros(BITS, np.int64), 0
    for part in parts:
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        counts, n = counts + bits.sum(axis=0, dtype=np.int64), n + len(bits)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, column: str = "fp") -> DataFrame:
    """docs without the text, with the fingerprint in `column`; null texts have no words."""
    keep = [c for c in docs.columns if c != text]

    def run(batches):
        for b in batches:
            made = pa.array([fingerprint(t, shingle) for t in raw(b, text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), made], [*keep, column])

    small_batches(docs.sparkSession)
    rest = docs.select(keep).schema
    return docs.mapInArrow(run, rest.add(column, "long"))


def _anchored(batches):
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for half in (0, 1):
            part = (fp >> _U(32 * half)) & _U((1 << 31) - 1)
            syndrome = _LOW[part & _U(0xFFFF)] ^ _HIGH[part >> _U(16)]
            for s in np.unique(syndrome):
                own = syndrome == s
                anchors = (part[own][:, None] ^ _FLIPS[s][None, :]) | _U(half << 31)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.ravel().view(np.int64)), pa.array(np.repeat(fp[own], anchors.shape[1]).view(np.int64))], ["anchor", "fp"])


def _group_links(fp: np.ndarray, within: int):
    """Links that span the components of one large group: breadth first over blocks of rows, at most one link a row."""
    left = np.arange(len(fp))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            parent = np.full(len(left), -1)
            for k in range(0, len(front), BLOCK):
                for m in range(0, len(left), BLOCK * 8):
                    near = np.bitwise_count(fp[front[k : k + BLOCK]][:, None] ^ fp[left[m : m + BLOCK * 8]][None, :]) <= within
                    hit = near.any(axis=0) & (parent[m : m + BLOCK * 8] < 0)
                    parent[m : m + BLOCK * 8][hit] = front[k + near.argmax(axis=0)[hit]]
            found = parent >= 0
            yield fp[parent[found]], fp[left[found]]
            front, left = left[found], left[~found]


def _compared(within: int):
    def of(anchor, fp):
        size = np.diff(np.append(starts := np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor)))
        large = np.repeat(size > SMALL_GROUP, size)
        a, f, d = anchor[~large], fp[~large], 1
        while len(a) > d and (same := a[d:] == a[:-d]).any():
            near = same & (np.bitwise_count(f[d:] ^ f[:-d]) <= within)
            yield f[:-d][near], f[d:][near]
            d += 1
        for k in np.flatnonzero(size > SMALL_GROUP):
            yield from _group_links(fp[starts[k] : starts[k] + size[k]], within)

    def run(batches):
        held_a, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        batches = iter(batches)
        while True:
            b = next(batches, None)
            if b is not None:
                held_a = np.append(held_a, b.column(0).to_numpy(zero_copy_only=False))
                held_f = np.append(held_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            # the last anchor's group may go on in the next batch
            cut = len(held_a) if b is None else int(np.searchsorted(held_a, held_a[-1])) if len(held_a) else 0
            for x, y in of(held_a[:cut], held_f[:cut]) if cut else ():
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])
            held_a, held_f = held_a[cut:], held_f[cut:]
            if b is None:
                return

    return run


def links(distinct: DataFrame) -> DataFrame:
    """One column of distinct fingerprints -> pairs (a, b) of fingerprints within THRESHOLD bits
    that connect exactly what all such pairs connect. A large group gives a spanning forest, not all pairs."""
    spark = distinct.sparkSession
    small_batches(spark)
    held = distinct.mapInArrow(_anchored, "anchor long, fp long")
    dealt = held.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compared(THRESHOLD), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) for every document: component_id is the smallest id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows keep one
    row each. A null id takes part under its fingerprint; a component of null ids has a null
    component_id. An empty table gives no rows. Other columns of docs are not read.
    """
    made = durable(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", shingle), "simhash")
    held = durable(made.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    root = components(links(held.select("fp")), "simhash-cc")
    named = held.join(root, held.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    label = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = durable(named.join(label, "root").select("fp", "component_id"), "simhash-labels")
    return made.join(label, "fp").select("id", "fp", "component_id")


def keep_least(docs: DataFrame, ids: DataFrame, id_col: str, text: str) -> DataFrame:
    """Keep of each component of ids (id, component_id) the row with the smallest id, with all its columns.

    Rows that share an id stand or fall together, and exact repeats among them (same id, same
    text) leave one row. A row with a null id is kept if its id cannot be compared with another's,
    that is always: it is never removed in favour of a row it could not be told apart from.
    """
    key, repeated = fresh(docs, "keeper", "repeated")
    keep = ids.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.max(F.expr("id = component_id")).alias("stays"))
    keep = keep.where("stays").select(F.col("id").alias(key), (F.col("n") > 1).alias(repeated))
    kept = docs.join(keep, docs[id_col] == F.col(key))
    once = kept.where(~F.col(repeated)).select(docs.columns)
    more = kept.where(F.col(repeated)).withColumn(key, F.xxhash64(text)).dropDuplicates([id_col, key]).select(docs.columns)
    return once.unionByName(more).unionByName(docs.where(F.col(id_col).isNull()))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: doc_id, fingerprint (16 hex digits), component_id."""
    out = classes(read(spark, sf_dir, "documents"), shingle=3)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
