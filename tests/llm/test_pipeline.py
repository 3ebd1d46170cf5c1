"""The pipeline's stages on their own inputs, against plain versions."""

from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as cp
from panelyard.llm import decontam, mixing, nearcopies, toxicity
from panelyard.llm.labelled import fold

from .test_first import ODD, SCHEMA, _ascii_lower, _hits, _roots

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]
    assert cp.ORACLE_SQL is None


def test_toxicity_stage(spark, docs):
    kept = {r.doc_id for r in cp.reject_toxic(spark, docs, SF).collect()}
    scored = toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet"), fold("doc_id", 5) != 0).collect()
    assert kept == {r.doc_id for r in scored if r.score < 0.5} and 0 < len(kept) <= len(scored)


def test_fingerprints_make_candidates_of_the_near_copy_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").select(F.col("doc_id").alias("id"), "text")
    made = nearcopies.signatures(rows, 5, 2).collect()
    texts = {r.id: r.text for r in rows.collect()}
    assert len(made) == len(texts)

    def plain(text):
        w = _ascii_lower(text or "").encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {r.id: plain(texts[r.id]) for r in made}
    assert {r.id: r.fp & (1 << 64) - 1 for r in made} == fps
    units = {}
    for r in made:
        units.setdefault(r.unit, fps[r.id])
    order = sorted(units)
    roots = _roots(len(order), [(i, j) for i in range(len(order)) for j in range(i) if (units[order[i]] ^ units[order[j]]).bit_count() <= 3])
    want, got = defaultdict(set), defaultdict(set)
    for u, r in zip(order, roots, strict=True):
        want[r].add(u)
    for r in nearcopies.fingerprint_groups(nearcopies.signatures(rows, 5, 2)).collect():
        got[r.sig].add(r.unit)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) < len(order)


def test_decontamination_stage(spark, docs):
    kept = {r.doc_id for r in cp.drop_contaminated(spark, docs, SF).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = set()
    for r in docs.collect():
        n, hit, _ = _hits(r.text, items)
        if not (hit > 0 and 20 * hit >= n):
            want.add(r.doc_id)
    assert kept == want


def test_mixing_stage(spark, docs):
    got = Counter(r.doc_id for r in cp.mix_sources(spark, docs, SF).collect())
    want = {r.doc_id: r.copies for r in mixing.mix(docs, mixing.words_of(F.col("text"))).collect() if r.copies}
    assert got == want and max(want.values()) <= 3


def test_sharding_stage(spark, docs):
    got = cp.shard(spark, docs, SF)
    assert got.columns == [*docs.columns, "shard", "slot"]
    slots = defaultdict(list)
    for r in got.collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_whole_pipeline_and_reruns(spark):
    a, b = (sorted(map(tuple, cp.run(spark, SF).select("doc_id", "shard", "slot").collect())) for _ in range(2))
    assert a == b and a


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES])
def test_stages_on_odd_rows(spark, stage):
    odd = spark.createDataFrame(ODD, SCHEMA).withColumn("copies", F.lit(1)).withColumn("score", F.lit(2)).withColumn("copy", F.lit(3))
    got = stage(spark, odd, SF)
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() >= 1
    assert stage(spark, odd.limit(0), SF).count() == 0
