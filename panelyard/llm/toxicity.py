"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of the words in it
and their beginnings, a document's the noisy-or of its sentences': it is toxic if one of them
is. Only documents are labelled; the weights are learned through the noisy-or by gradient steps
on a bounded labelled sample, over the words and beginnings that occur in several of its
documents and more in those of one label. Others weigh nothing, so a long text does not become
toxic by its length. The sentences with the
highest scores tell where the offence is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import raw, read, small_batches
from .labelled import fold, restored, sample

#: The labelled sample: rows per class, and bytes of a text that is learned from.
PER_CLASS, MAX_BYTES = 1500, 64 << 10
MIN_DOCS, STEPS, RATE, DECAY = 4, 200, 0.15, 2e-5
#: Bytes of the beginnings of words; standard errors by which a feature's shares of the labels must differ.
STEMS, APART = range(3, 11), 2.5
_CACHE = 200_000
#: Words: ASCII letters and digits, lower-cased, and all else beyond ASCII. Sentences end at . ! ? and line ends.
_SPLIT = bytes(10 if c in b".!?\n\r" else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def sentences(text: bytes | None) -> list[list[bytes]]:
    """The words of the sentences; those without words are empty lists."""
    return [s.split() for s in (text or b"").translate(_SPLIT).split(b"\n")]


def features(word: bytes) -> list[bytes]:
    """The whole word, marked, and its beginnings."""
    return [word + b"$", *(word[:k] for k in STEMS if k < len(word))]


class Model:
    """Weights of words and beginnings, and the bias of a sentence."""

    def __init__(self, texts: list[bytes], labels: list[int], share: float):
        self.share, self.weights, self.bias = share, {}, -20.0
        bags = [[sorted(set(s)) for s in sentences(t) if s] for t in texts]
        count: tuple[dict, dict] = ({}, {})
        for bag, y in zip(bags, labels, strict=True):
            for f in {f for w in {w for s in bag for w in s} for f in features(w)}:
                count[y][f] = count[y].get(f, 0) + 1
        n, names = [max(1, labels.count(y)) for y in (0, 1)], []
        for f in sorted(count[0].keys() | count[1].keys()):
            p, q = count[0].get(f, 0), count[1].get(f, 0)
            mean = (p + q) / (n[0] + n[1])
            error = np.sqrt(mean * (1 - mean) * (1 / n[0] + 1 / n[1])) + 1e-12
            if p + q >= MIN_DOCS and abs(q / n[1] - p / n[0]) > APART * error:
                names.append(f)
        kept = [(bag, y) for bag, y in zip(bags, labels, strict=True) if bag]
        if len({y for _, y in kept}) < 2 or not names:
            self.bias = -20.0 if share < 0.5 else 20.0
            return
        at = {w: k for k, w in enumerate(names)}
        last = len(names)  # a column without weight, so that no sentence is empty
        ids, size, per, y = [], [], [], np.array([y for _, y in kept], float)
        for bag, _ in kept:
            per.append(len(bag))
            for s in bag:
                own = [at[f] for w in s for f in features(w) if f in at] + [last]
                ids += own
                size.append(len(own))
        self._fit(np.array(ids), np.array(size), np.array(per), y, last)
        self.weights = {w: float(v) for w, v in zip(names, self.theta, strict=True) if abs(v) > 1e-2}
        del self.theta

    @staticmethod
    def gradient(theta, bias, ids, size, per, y) -> tuple[float, np.ndarray]:
        """(mean log-likelihood, its slopes by the weights and the bias): ids are the sentences' features one
        after another, size how many each sentence has, per how many sentences each document has."""
        starts, docs = np.cumsum(np.append(0, size[:-1])), np.cumsum(np.append(0, per[:-1]))
        of = np.repeat(np.arange(len(per)), per)
        z = np.clip(np.add.reduceat(theta[ids], starts) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), docs))
        likely = np.log(np.maximum(np.where(y == 1, 1 - clean, clean), 1e-300)).mean()
        # d log-likelihood / dz: for a toxic document p (1 - P) / P, for a clean one -p
        slope = np.where(y[of] == 1, p * (clean / np.maximum(1 - clean, 1e-9))[of], -p) / len(per)
        return float(likely), np.append(np.bincount(ids, np.repeat(slope, size), len(theta)), slope.sum())

    def _fit(self, ids, size, per, y, last) -> None:
        theta, bias = np.zeros(last + 1), -float(np.log(per.mean())) - 1
        first, second, step = np.zeros(last + 2), np.zeros(last + 2), 0
        while step < STEPS:
            step += 1
            g = self.gradient(theta, bias, ids, size, per, y)[1]
            g[:last] -= DECAY * theta[:last]
            g[last] = 0
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            theta, bias = theta + move[:-1], bias + move[-1]
        self.theta, self.bias = theta[:last], float(bias)

    def score(self, text: bytes | None, known: dict) -> tuple[float, int, float]:
        """(document score, number of the worst sentence or -1, its score). known: weights of words met before."""
        if len(known) > _CACHE:
            known.clear()
        bags = sentences(text)
        z = np.full(len(bags), -np.inf)
        for k, s in enumerate(bags):
            if s:
                total = self.bias
                for w in set(s):
                    v = known.get(w)
                    if v is None:
                        v = known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
                    total += v
                z[k] = total
        if not np.isfinite(z).any():
            return 0.0, -1, 0.0
        p = 1 / (1 + np.exp(-np.clip(z, -500, 30)))
        worst = int(p.argmax())
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-15)).sum())), worst, float(p[worst])


def _place(text: bytes, number: int) -> tuple[int, int]:
    """Code points of the start and end of a sentence."""
    marks = [-1, *(i for i, c in enumerate(text.translate(_SPLIT)) if c == 10), len(text)]
    start, end = marks[number] + 1, marks[number + 1]
    return len(text[:start].decode(errors="ignore")), len(text[:end].decode(errors="ignore"))


def score(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `score`, and `worst_start`, `worst_end`, `worst_score` of the sentence that weighs most.

    Columns of these names are replaced. Only the text is an input. Null, empty and wordless
    texts score 0 and have no worst sentence (null); without labels of both kinds to learn from every other text
    scores near the label that is known. Rows are never merged or dropped; an empty table gives no rows.
    """
    spark = docs.sparkSession
    made = ["score", "worst_start", "worst_end", "worst_score"]
    docs = docs.drop(*made)
    small_batches(spark)
    texts, ys, share = sample(docs, labels, label, learn, id_col, text, PER_CLASS, MAX_BYTES)
    sent = spark.sparkContext.broadcast(vars(Model(texts, ys, share)))

    def run(batches):
        model, known = restored(Model, sent.value), {}
        for b in batches:
            out = [[], [], [], []]
            for t in raw(b, text):
                total, worst, own = model.score(t, known)
                start, end = _place(t, worst) if worst >= 0 and own >= 0.01 else (None, None)
                for c, v in zip(out, (total, start, end, own if start is not None else None), strict=True):
                    c.append(v)
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.float64(), pa.int32(), pa.int32(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, *made])

    schema = StructType(list(docs.schema)).add("score", "double").add("worst_start", "integer").add("worst_end", "integer").add("worst_score", "double")
    return docs.mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: rows whose crc32 of doc_id is 0 modulo 5 are held out of learning."""
    out = score(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
