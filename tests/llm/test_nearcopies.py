"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

import re

import numpy as np

import corpus_pipeline as cp
from panelyard.llm.common import WORD

from .test_first import SCHEMA, SF, _ascii_lower, _roots


def _set(text):
    w = re.findall(WORD, _ascii_lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _kept(rows):
    sets = [_set(t) for _, t in rows]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])]
    return {rows[r][0] for r in _roots(len(rows), pairs)}, len(pairs)


def test_edited_copies_go_at_jaccard_080(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(80):  # each text with three copies of one to eight changed words
        words = [f"w{x}" for x in rng.integers(0, 4000, 150)]
        rows.append((4 * k, " ".join(words)))
        for c in range(1, 4):
            copy = list(words)
            for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
                copy[at] = "new"
            rows.append((4 * k + c, " ".join(copy)))
    want, n = _kept(rows)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    assert n > 100 and {r.doc_id for r in cp.drop_near_copies(spark, docs, SF).collect()} == want


def test_stage_on_the_table_is_brute_force_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    assert {r.doc_id for r in cp.drop_near_copies(spark, docs, SF).collect()} == _kept(rows)[0]


def test_stage_on_a_larger_table(spark):
    """Every link, of exact and edited copies, on the table with planted ones: pairs met by a common shingle."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    sets, holders = [_set(t) for _, t in rows], {}
    for i, own in enumerate(sets):
        for x in own:
            holders.setdefault(x, []).append(i)
    near = {(i, j) for own in holders.values() for i in own for j in own if j < i}
    pairs = [(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = {rows[r][0] for r in _roots(len(rows), pairs)}
    kept = {r.doc_id for r in cp.drop_near_copies(spark, docs, sf).collect()}
    assert want <= kept and len(kept - want) <= 0.01 * (len(rows) - len(want)) and len(pairs) > 50
