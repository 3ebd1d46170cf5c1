"""SimHash near-dedup of a corpus at a Jaccard similarity of 0.8: candidates by fingerprints and by bands, exact Jaccard, components.

The fingerprints and their links by anchor points are those of simhash.py, over five-word
shingles. Within their 3 bits lie only the nearest copies: at a similarity of 0.8 two fingerprints
differ in about ten bits of 64, some in twenty, and that near lie also many pairs that share
nothing. So further candidates are the documents whose MinHash band signatures collide, with as
many bands as find a pair at the threshold with the asked recall. Each candidate, of either kind,
is verified by the exact Jaccard similarity of the sets of word shingles. Documents of equal words
fall together by a 64-bit hash before that.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import simhash
from .common import bitmap, durable, passing, raw, small_batches
from .components import components
from .paragraphs import bands, minima, near_links, unit_of
from .simhash import keep_least

SHINGLE, LEAST, RECALL, ROWS = 5, 0.8, 0.999, 4


def hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles, in order; fewer words than `size` are one shingle."""
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    last, digest = min(size, len(words)), xxhash.xxh64_digest
    made = b"".join([digest(joined[ends[i] : max(0, ends[i + last] - 1)]) for i in range(n)])
    return np.frombuffer(made, ">u8").astype(np.uint64)


def signatures(docs: DataFrame, size: int, n_bands: int, rows: int = ROWS) -> DataFrame:
    """(id, unit, fp, sigs) of (id, text): the hash of a document's words, the fingerprint of its shingles and
    its band signatures. Null texts have no words; their fingerprint is zero."""
    salt = np.arange(1, n_bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def run(batches):
        for b in batches:
            units, fps, sigs = [], [], []
            for t in raw(b, "text"):
                words = (t or b"").lower().split()
                units.append(unit_of(b" ".join(words)))
                own = hashes(words, size)
                fps.append(simhash.majority([own.byteswap().tobytes()]) if words else 0)
                own = np.unique(own)
                low = minima(own, np.array([len(own)]), n_bands * rows).reshape(n_bands, rows)
                mixed = salt.copy()
                for r in range(rows):
                    mixed = (mixed ^ low[:, r]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                sigs.append(mixed.view(np.int64))
            flat = pa.array(np.concatenate(sigs) if sigs else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1) * n_bands, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units, pa.int64()), pa.array(fps, pa.int64()), lists], ["id", "unit", "fp", "sigs"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.select("id").schema.add("unit", "long").add("fp", "long").add("sigs", ArrayType(LongType())))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(unit, packed) of the wanted documents' words: the sorted distinct hashes of their shingles as bytes."""
    sent = bitmap(wanted)

    def run(batches):
        mask = sent.value
        for b in batches:
            found = {}
            for t in raw(b, "text"):
                words = (t or b"").lower().split()
                u = unit_of(b" ".join(words))
                at = u % (len(mask) << 3)
                if mask[at >> 3] >> (at & 7) & 1 and u not in found:
                    found[u] = np.unique(hashes(words, size)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["unit", "packed"])

    small_batches(docs.sparkSession)
    made = docs.select("text").mapInArrow(run, "unit long, packed binary").join(wanted, "unit", "left_semi")
    return made.groupBy("unit").agg(F.first("packed").alias("packed"))


def fingerprint_groups(made: DataFrame) -> DataFrame:
    """(sig, unit): units whose fingerprints link, each group under a signature of its own."""
    held = durable(made.groupBy("unit").agg(F.min("fp").alias("fp")), "copies-fingerprints")
    root = durable(components(simhash.links(held.select("fp").distinct()), "copies-fingerprints-cc"), "copies-fingerprint-roots")
    grouped = held.join(root, held.fp == root.node, "left")
    return grouped.select(F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("sig"), "unit")


def links(docs: DataFrame, made: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b) links between units that connect what all candidate pairs of similarity `least` or more connect."""
    pairs = made.select("unit", F.explode("sigs").alias("sig")).select("sig", "unit").union(fingerprint_groups(made))
    often = pairs.groupBy("sig").agg(F.min("unit").alias("x"), F.max("unit").alias("y")).where("x <> y").select("sig")
    often = durable(often, "copies-collisions")
    members = passing(pairs, "sig", bitmap(often)).join(often, "sig", "left_semi").distinct()
    members = durable(members, "copies-members")
    sets = durable(_sets(docs, members.select("unit").distinct(), size), "copies-sets")
    return near_links(members, sets, least, lambda packed: [np.frombuffer(x, np.uint64) for x in packed])


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """(id, component_id) for every document: component_id is the smallest id reachable over
    pairs whose sets of lower-cased (A-Z) word shingles have a Jaccard similarity of `least` or more.

    Null and empty texts are copies of each other. Repeated rows keep one row each. A null id
    takes part by its text; a component of null ids has a null component_id. An empty table
    gives no rows. Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    made = durable(signatures(rows, shingle, bands(least, recall, ROWS)), "copies")
    root = components(links(rows, made, shingle, least), "copies-cc")
    held = made.groupBy("unit").agg(F.min("id").alias("least"))
    named = held.join(root, held.unit == root.node, "left").select("unit", "least", F.coalesce("root", "unit").alias("root"))
    named = durable(named, "copies-roots")
    label = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = durable(named.join(label, "root").select("unit", "component_id"), "copies-labels")
    return made.join(label, "unit").select("id", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """Keep of each component the row with the smallest id, with all its columns; see simhash.keep_least."""
    return keep_least(docs, classes(docs, id_col, text, shingle, least), id_col, text)
