"""The corpus pipeline: toxicity, near-duplicates, contamination, mixing, sharding, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents. Stages read the other tables they need from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import decontam, mixing, nearcopies, sharding, toxicity
from panelyard.llm.common import discard, durable, fresh, read
from panelyard.llm.labelled import fold

SHARDS = 24


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below one half stay, labelled ones included: only the score decides."""
    scored = toxicity.score(docs, read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return scored.where("score < 0.5").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles of 0.8 or more) the document
    with the smallest id stays. Candidates are SimHash groups by anchor points, and MinHash bands for what 3 bits miss."""
    return nearcopies.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go if benchmark windows cover at least a twentieth of their words."""
    found = decontam.scan(docs, read(spark, sf_dir, "benchmark"), keep_text=True)
    return found.where("not contaminated").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or repeated."""
    taken = mixing.mix(docs, mixing.words_of(F.col("text"))).where("copies > 0")
    copy = fresh(docs, "copy")[0]
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias(copy)).drop(copy)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and their slot in it, after a two-pass shuffle."""
    return sharding.shuffle_shards(docs, SHARDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: Trained scores, XXH64 fingerprints and seeded draws have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, durable(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if k:  # a stage's table goes once the next one's is written; the corpus itself is not ours
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
