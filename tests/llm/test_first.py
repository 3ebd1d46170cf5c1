"""Sharding, mixing, SimHash and decontamination against brute force and on odd rows."""

import functools
import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from panelyard.llm import decontam, mixing, nearcopies, sharding, simhash
from panelyard.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, " \t\n", None, None, 3), (4, "One word", "en", "a", 8), (4, "One word", "en", "a", 8),
    (None, "one WORD", "en", "b", 8), (6, "the quick brown fox jumps over the lazy dog " * 3000, "en", "b", 1), (7, "été ÀB ß", "fr", "c", 8),
    (8, "the quick brown fox jumps over the lazy dog " * 3000, "en", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def _fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", _ascii_lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(n, pairs):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [_fingerprint(r.text) for r in docs]
    roots = _roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = {(r.doc_id, f"{f:016x}", docs[k].doc_id) for r, f, k in zip(docs, fps, roots, strict=True)}
    assert {tuple(r) for r in simhash.op5(spark, SF).collect()} == want


def test_links_connect_all_within_three_bits(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(map(int, base))
    for b in base[:20]:  # chains and balls
        x = int(b)
        for _ in range(30):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    for _ in range(1500):
        x = int(base[30])
        for bit in rng.choice(64, 2, replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    roots = _roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = dict(components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect())
    of = [got.get(s, s) for s in signed]
    groups, wanted = defaultdict(set), defaultdict(set)
    for s, g, w in zip(signed, of, roots, strict=True):
        groups[g].add(s)
        wanted[w].add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_group_links_span_large_groups():
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    pairs = [(int(a), int(b)) for x, y in simhash._group_links(fp, 3) for a, b in zip(x, y, strict=True)]
    assert len(pairs) < len(fp)
    at = {int(f): i for i, f in enumerate(fp)}
    full = [(i, j) for i in range(len(fp)) for j in range(i) if (int(fp[i]) ^ int(fp[j])).bit_count() <= 3]
    assert _roots(len(fp), [(at[a], at[b]) for a, b in pairs]) == _roots(len(fp), full)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_rows(odd, none):
    got = sorted(map(tuple, simhash.classes(odd).select("id", "component_id").collect()), key=str)
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, 4), (6, 6), (8, 6), (7, 7)], key=str)
    assert simhash.classes(none).count() == 0 and nearcopies.dedup(none).count() == 0
    kept = nearcopies.dedup(odd.withColumn("keeper", F.lit(1)).withColumn("fp", F.lit("x")))
    assert kept.columns == [*odd.columns, "keeper", "fp"]
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "4", "6", "7", "None"]


def test_sharding_digest(spark):
    rows = sharding.op2(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        t = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 8, zlib.crc32(t), "key")
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, sharding.op2(spark, SF).collect()))
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sum(a < b for a, b in zip(order, order[1:])) < 0.7 * len(order)


def test_sharding_odd_rows(odd, none, tmp_path):
    got = sharding.shuffle_shards(odd.withColumn("bucket", F.lit(1)).withColumn("shard", F.lit("x")), 3, bucket_bytes=40_000)
    rows = got.collect()
    assert len(rows) == len(ODD) and got.columns == [*odd.columns, "bucket", "shard", "slot"]
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shuffle_shards(none, 3).count() == 0
    sharding.write_shards(odd, str(tmp_path / "out"), 3)
    for s in {r.shard for r in rows}:
        files = sorted((tmp_path / "out" / f"shard={s}").glob("*.parquet"))
        slots = [x for f in files for x in pq.read_table(f, columns=["slot"]).column(0).to_pylist()]
        assert slots == list(range(sum(r.shard == s for r in rows)))  # in the order of the files


def _plain_shards(rows, shards, per_shard, seed):
    """(id, text) rows -> (id, shard, slot): every hash, bucket and swap recomputed without Spark."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    xx = lambda b, h: xxhash.xxh64_intdigest(b, h)
    chained = lambda *parts: signed(functools.reduce(lambda h, b: xx(b, h), parts, 42))
    i32, i64 = (lambda v: struct.pack("<i", v)), (lambda v: struct.pack("<q", v))
    dealt = defaultdict(list)
    for i, t in rows:
        key = [] if i is None else [i64(i)]  # a null leaves the hash as it is
        mark = signed(42 if t is None else xx(t.encode(), 42))
        shard = max((chained(i32(seed), *key, i32(s)), s) for s in range(shards))[1]
        dealt[shard, chained(i32(seed + 1), *key, i64(mark)) % per_shard].append((i is None, i or 0, mark, i))
    out, first = set(), defaultdict(int)
    for (shard, bucket), own in sorted(dealt.items()):
        own.sort()
        n, rng = len(own), np.random.default_rng([seed, shard, bucket])
        for k, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)), strict=True):
            own[k], own[j] = own[j], own[k]
        out |= {(r[3], shard, first[shard] + k) for k, r in enumerate(own)}
        first[shard] += n
    return out


def test_shards_and_slots_match_plain_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.op2(spark, SF).collect()} == _plain_shards(rows, 24, 1, sharding.SEED)
    total = sum(len((t or "").encode()) + 72 for _, t in rows)
    got = sharding.shuffle_shards(docs, 5, seed=7, bucket_bytes=20_000).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == _plain_shards(rows, 5, -(-total // 100_000), 7)
    grown = {(r.doc_id, r.shard) for r in sharding.shuffle_shards(docs, 25).collect()}
    assert grown == {(r.doc_id, r.grown_shard) for r in sharding.op2(spark, SF).collect()}


def test_many_buckets_join_their_first_slots(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, sharding.shuffle_shards(docs, 5, bucket_bytes=20_000).drop("text").collect()))
    monkeypatch.setattr(sharding, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, sharding.shuffle_shards(docs, 5, bucket_bytes=20_000).drop("text").collect())) == want


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(0)
    seen = defaultdict(int)
    for _ in range(6000):
        seen[tuple(sharding._fisher_yates(3, rng))] += 1
    assert len(seen) == 6 and min(seen.values()) > 850


def _targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


def test_mixing_digest(spark):
    rows = mixing.op3(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for k, r in docs.items()}
    per, taken = defaultdict(int), defaultdict(int)
    for k, r in docs.items():
        per[r.source] += size[k]
    want = _targets(per)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == per[s] and r.target == pytest.approx(want[s])
        assert r.size == 0 or (r.taken % r.size == 0 and r.taken <= 3 * r.size)
        taken[s] += r.taken
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for s in per:
        assert abs(taken[s] - want[s]) <= 0.002 * per[s] + 20
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op3(spark, "/root/testdata/sf0.01").collect()))


def test_mixing_levels_and_balance(spark):
    df = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, null, concat('s', id % 4)) source", "1 + id * 7919 % 500 n")
    rows = mixing.mix(df, F.col("n"), block=50).collect()
    assert len(rows) == 3000
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) < 60
        expected = len(own) * own[0].target / own[0].source_size
        assert abs(sum(r.copies for r in own) - expected) < 8


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    size, p = rng.integers(1, 1000, 400).astype(float), np.full(400, 0.37)
    end = mixing._flight(p, size, rng)
    assert ((end > 0) & (end < 1)).sum() <= 2
    assert end.sum() == pytest.approx(p.sum()) and (end * size).sum() == pytest.approx((p * size).sum())


def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd.withColumn("p", F.lit(9)).withColumn("size", F.lit(-1)), mixing.words_of(F.col("text"))).collect()
    assert len(got) == len(ODD) and all(r.copies == 0 for r in got if r.size == 0)
    assert mixing.mix(none, mixing.words_of(F.col("text"))).count() == 0


def _hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _ascii_lower(t or ""))
    w, mark, found = split(text), set(), set()
    for i, t in items:
        b = split(t)
        if b and i is not None:
            n = min(13, len(b))
            windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    mark |= set(range(k, k + n))
                    found.add(str(i))
    return len(w), len(mark), sorted(found)


def test_decontamination_matches_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet").collect(), [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in decontam.op7(spark, SF).collect()}
    for d in docs:
        n, hit, found = _hits(d.text, items)
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())
        assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert any(r.contaminated for r in got.values())


def test_decontamination_small_and_split_benchmarks(spark, odd, none, monkeypatch):
    monkeypatch.setattr(decontam, "PARTS_A_PASS", 3)
    items = [(1, "quick brown"), (1, "lazy"), (2, "One WORD"), (3, "fox jumps over the lazy dog the quick brown fox jumps over the lazy"), (None, "one"), (4, None), (5, " . "), (6, "ÀB"), (7, "été")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1, 1 << 20):
        got = decontam.scan(odd.withColumn("items", F.lit(1)), bench, part_bytes=size).collect()
        want = sorted((str(r[0]), *_hits(r[1], items)) for r in ODD)
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want
    assert not any(r.n_hit for r in decontam.scan(odd, bench.limit(0)).collect())
    assert decontam.scan(none, bench).count() == 0
