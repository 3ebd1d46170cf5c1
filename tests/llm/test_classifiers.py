"""The classifiers against plain loops: votes by every cosine, noisy-or of every sentence, slopes by differences."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from panelyard.llm import quality, toxicity
from panelyard.llm.labelled import fold, sample

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")


def _plain_vector(model, text):
    """A text in the latent space, column by column."""
    counts, tokens = {}, (text or "").encode().split()
    for t in tokens:
        for c in quality._columns(t):
            counts[c] = counts.get(c, 0) + 1.0
    again = sum(a == b for a, b in zip(tokens, tokens[1:]))
    if again * 10 > len(tokens):
        last = quality.WORDS + quality.SHAPES - 1
        counts[last] = counts.get(last, 0) + 10.0 * again
    weights = {c: math.log1p(n) * model.idf[c] for c, n in counts.items()}
    out = np.zeros(model.space.shape[1])
    for words in (True, False):
        own = {c: w for c, w in weights.items() if (c < quality.WORDS) == words}
        norm = math.sqrt(sum(w * w for w in own.values())) or 1.0
        for c, w in own.items():
            out += w / norm * model.space[c].astype(float)
    return out


def test_quality_votes_match_every_cosine(spark, tables):
    docs, labels = tables
    learn = fold("doc_id", 3) != 1
    n, frequency = quality.document_frequencies(docs, "text")
    rows = docs.collect()
    assert n == len(rows)
    seen = np.zeros(quality.WORDS + quality.SHAPES, int)
    for r in rows:
        own = {c for t in (r.text or "").encode().split() for c in quality._columns(t)}
        tokens = (r.text or "").split()
        if sum(a == b for a, b in zip(tokens, tokens[1:])) * 10 > len(tokens):
            own.add(quality.WORDS + quality.SHAPES - 1)
        seen[list(own)] += 1
    assert (seen == frequency).all()
    texts, ys, share = sample(docs, labels, "quality", learn, "doc_id", "text", quality.PER_CLASS, quality.MAX_BYTES)
    model = quality.Model(texts, ys, share, n, frequency)
    voters = np.array([v / np.linalg.norm(v) for v in (_plain_vector(model, t.decode()) for t in texts)])
    assert np.allclose(voters, model.voters, atol=2e-4)
    got = {r.doc_id: r.score for r in quality.score(docs, labels, learn).collect()}
    close = 0
    for r in rows:
        v = _plain_vector(model, r.text)
        if not v.any():
            assert got[r.doc_id] == share
            continue
        cosine = sorted(((float(x @ v) / float(np.linalg.norm(v)), y) for x, y in zip(voters, ys)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(c, 1e-6) ** 4 for c, _ in cosine]
        close += abs(sum(w * y for w, (_, y) in zip(weight, cosine)) / sum(weight) - got[r.doc_id]) < 0.01  # single precision may swap the last neighbours
    assert close >= 0.99 * len(rows)


def _plain_noisy_or(model, text):
    keep = 1.0
    for s in re.split(rb"[.!?\n\r]", (text or "").encode()):
        words = set(re.sub(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", b" ", s.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))).split())
        if words:
            z = model.bias + sum(model.weights.get(w + b"$", 0.0) + sum(model.weights.get(w[:k], 0.0) for k in range(3, 11) if k < len(w)) for w in words)
            keep *= 1 - 1 / (1 + math.exp(-z)) if z > -500 else 1.0
    return 1 - keep


def test_toxicity_is_the_noisy_or_of_its_sentences(spark, tables):
    docs, labels = tables
    learn = fold("doc_id", 5) != 0
    texts, ys, share = sample(docs, labels, "toxic", learn, "doc_id", "text", toxicity.PER_CLASS, toxicity.MAX_BYTES)
    model = toxicity.Model(texts, ys, share)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels, learn).collect()}
    want = {r.doc_id: _plain_noisy_or(model, r.text) for r in docs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert sum(w >= 0.5 for w in want.values()) > 10


def test_toxicity_slopes_match_differences():
    rng = np.random.default_rng(3)
    per = rng.integers(1, 5, 40)
    size = rng.integers(1, 7, per.sum())
    ids, y = rng.integers(0, 30, size.sum()), (np.arange(40) % 2).astype(float)
    theta, bias = rng.normal(size=31) * 0.5, -0.7
    g = toxicity.Model.gradient(theta, bias, ids, size, per, y)[1]
    at = lambda t, b: toxicity.Model.gradient(t, b, ids, size, per, y)[0]
    for k in range(31):
        e = np.zeros(31)
        e[k] = 1e-6
        assert abs((at(theta + e, bias) - at(theta - e, bias)) / 2e-6 - g[k]) < 1e-6
    assert abs((at(theta, bias + 1e-6) - at(theta, bias - 1e-6)) / 2e-6 - g[31]) < 1e-6
    # the likelihood itself, document by document
    first = np.cumsum(np.append(0, size))
    sentence = [1 / (1 + math.exp(-(theta[ids[a:b]].sum() + bias))) for a, b in zip(first, first[1:])]
    total, k = 0.0, 0
    for n, label in zip(per, y):
        clean = math.prod(1 - p for p in sentence[k : k + n])
        total, k = total + math.log(1 - clean if label else clean), k + n
    assert abs(total / 40 - at(theta, bias)) < 1e-9


def test_toxicity_stage_keeps_what_a_plain_score_keeps(spark, tables):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = tables[1]
    texts, ys, share = sample(docs, labels, "toxic", fold("doc_id", 5) != 0, "doc_id", "text", toxicity.PER_CLASS, toxicity.MAX_BYTES)
    model = toxicity.Model(texts, ys, share)
    got = sorted(r.doc_id for r in cp.reject_toxic(spark, docs, SF).collect())
    assert got == sorted(r.doc_id for r in docs.collect() if _plain_noisy_or(model, r.text) < 0.5)
    assert 0 < len(got) < docs.count()


def test_sample_is_not_shrunk_by_missing_and_long_texts(spark):
    rows = [(k, None if k % 3 == 0 else "x " * 100_000 if k % 3 == 1 else f"word{k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    texts, ys, share = sample(docs, labels, "toxic", F.lit(True), "doc_id", "text", 40, 1000)
    assert ys.count(0) == ys.count(1) == 40 and share == 0.5 and all(t.startswith(b"word") for t in texts)
