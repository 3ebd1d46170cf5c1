"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of 13 words of each benchmark item (an item of fewer words is one
window). Windows of one length share a table. The table's shift entry for a block of two words
says how far the search may jump because no window has that block nearer to its end; a block
that ends a window leads to a bucket of windows with that suffix, and comparing the words
themselves confirms an occurrence. Clean text is passed at about twelve words a step.

Benchmarks are a stated query set: they are broadcast in parts of bounded size, and every
document is searched against each part in the same pass over the documents.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, fresh, raw, read, small_batches

WINDOW = 13
#: A part of the benchmark that is broadcast at once holds about this much text.
PART_BYTES = 4 << 20
#: Parts that one plan searches for before its rows are written.
PARTS_A_PASS = 8
#: Non-word ASCII becomes a space, A-Z lower case; bytes over 0x7F are parts of words.
_TO_WORDS = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


class Table:
    """Shift table and suffix buckets for windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.buckets: dict = {}
        self.longest = length - self.block + 1

    def add(self, window: tuple, item) -> None:
        for end in range(self.block, self.length + 1):
            b = window[end - self.block : end]
            self.shift[b] = min(self.shift.get(b, self.longest), self.length - end)
        self.buckets.setdefault(window[-self.block :], {}).setdefault(window, set()).add(item)

    def search(self, text: list[bytes]):
        """(first word, items) of every occurrence."""
        n, at, shift, longest, block = len(text), self.length, self.shift, self.longest, self.block
        while at <= n:
            b = (text[at - 2], text[at - 1]) if block == 2 else (text[at - 1],)
            jump = shift.get(b, longest)
            if jump:
                at += jump
                continue
            if found := self.buckets[b].get(tuple(text[at - self.length : at])):
                yield at - self.length, found
            at += 1


def tables(items, window: int = WINDOW) -> list[Table]:
    """Tables for (item id, text) pairs; items without words have no windows."""
    out: dict[int, Table] = {}
    for item, text in items:
        own = words(text)
        if own:
            length = min(window, len(own))
            table = out.setdefault(length, Table(length))
            for k in range(len(own) - length + 1):
                table.add(tuple(own[k : k + length]), item)
    return list(out.values())


_BUILT: dict = {}


def _built(part) -> list[Table]:
    if part.id not in _BUILT:
        _BUILT.clear()
        _BUILT[part.id] = tables(part.sent.value)
    return _BUILT[part.id]


class _Part:
    """A broadcast part of the benchmark."""

    def __init__(self, spark: SparkSession, rows: list):
        self.sent, self.id = spark.sparkContext.broadcast(rows), uuid.uuid4().hex


def parts(benchmark: DataFrame, id_col: str, text: str, part_bytes: int = PART_BYTES):
    """The benchmark's items as lists of bounded size; items go to parts by running size."""
    held, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("i is not null and t is not null").toLocalIterator():
        held.append((row.i, bytes(row.t)))
        size += len(row.t)
        if size >= part_bytes:
            yield held
            held, size = [], 0
    yield held


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES, keep_text: bool = False) -> DataFrame:
    """docs (without the text unless keep_text) with n_words, n_hit, items (sorted ids as strings) and contaminated.

    Columns of docs with these names are replaced. Null and empty texts have no words and are
    clean. Benchmark rows without an id, or without words, have no windows; items that share an
    id count as one. Rows of docs are never dropped or merged. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    hits, found = fresh(docs, "hit_ranges", "hit_items")
    new = ["n_words", "n_hit", "items", "contaminated"]
    docs = docs.drop(*new)
    out = docs.select("*", F.lit(None).cast("binary").alias(hits), F.array().cast("array<string>").alias(found), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"))

    def searcher(part: _Part):
        def run(batches):
            own = _built(part)
            for b in batches:
                marks, items, n_words = [], [], []
                for t, was, had in zip(raw(b, text), b.column(hits).to_pylist(), b.column(found).to_pylist(), strict=True):
                    w = words(t)
                    mark, ids = None if was is None else bytearray(was), set(had)
                    for table in own:
                        for k, which in table.search(w):
                            mark = mark if mark is not None else bytearray(len(w))
                            mark[k : k + table.length] = b"\1" * table.length
                            ids |= which
                    marks.append(None if mark is None else bytes(mark))
                    items.append(sorted(ids))
                    n_words.append(len(w))
                made = {hits: pa.array(marks, pa.binary()), found: pa.array(items, pa.list_(pa.string())), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array([sum(m or b"") for m in marks], pa.int64())}
                yield pa.RecordBatch.from_arrays([made.get(c, b.column(i)) for i, c in enumerate(b.schema.names)], b.schema.names)

        return run

    for number, rows in enumerate(parts(benchmark, item_id, item_text, part_bytes)):
        if number and number % PARTS_A_PASS == 0:  # a plan holds a bounded number of parts at once
            out = durable(out, "decontamination")
        out = out.mapInArrow(searcher(_Part(spark, rows)), out.schema)
    out = out.select(*(c for c in docs.columns if keep_text or c != text), "n_words", "n_hit", F.col(found).alias("items"))
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest."""
    out = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bl as (select item_id, w, least(13, len(w)) l from b where len(w) > 0 and item_id is not null),
bw as (select distinct item_id, l, array_to_string(w[k:k + l - 1], ' ') s from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) k from bl)),
dw as (select doc_id, k, l, array_to_string(w[k:k + l - 1], ' ') s from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) k from d, (select distinct l from bl))),
h as (select doc_id, k, dw.l l, item_id from dw join bw on dw.l = bw.l and dw.s = bw.s),
c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(k, k + l)) p from h) group by doc_id),
i as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) ids from (select distinct doc_id, item_id::varchar x from h) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join c on d.doc_id = c.doc_id left join i on d.doc_id = i.doc_id
"""
