"""Quality by nearest-neighbour voting in a latent semantic space.

Features of a text are its words, the shapes of its tokens (case, digits, trailing marks) and
how often a token follows itself, hashed into a fixed number of columns, weighted by log frequency and by inverse document
frequency over all documents. The latent space is a truncated singular value decomposition of a
bounded labelled sample. The sample's latent vectors are broadcast (their size is fixed by the
parameters); every document's cosines with all of them are exact blocked products, and the
nearest ones vote with their similarity.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import raw, read, small_batches
from .labelled import fold, restored, sample

WORDS, SHAPES, LATENT, NEIGHBOURS = 3072, 1024, 48, 25
#: The labelled sample: rows per class, and bytes of a text that is learned from.
PER_CLASS, MAX_BYTES = 1000, 64 << 10
_MARKS = re.compile(rb"[^0-9A-Za-z\x80-\xff]+$")
_CACHE = 200_000


def _columns(token: bytes) -> tuple[int, int]:
    core = _MARKS.sub(b"", token)
    case = b"U" if len(core) > 1 and core == core.upper() != core.lower() else b"T" if core[:1].isupper() else b"9" if core.isdigit() else b"l"
    shape = case + bytes([48 + min(len(core), 12)]) + token[len(core) :][:4]
    return zlib.crc32(core.lower()) % WORDS, WORDS + zlib.crc32(shape) % SHAPES


class Features:
    """Texts to sparse rows of counts; remembers the columns of tokens that it has met."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int]] = {}

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = (text or b"").split()
        known, counts = self.known, Counter(tokens)
        if len(known) > _CACHE:
            known.clear()
        ids = []
        for t in counts:
            c = known.get(t)
            if c is None:
                c = known[t] = _columns(t)
            ids.append(c)
        if not ids:
            return np.empty(0, np.int64), np.empty(0)
        both = np.bincount(np.array(ids).ravel(), np.repeat(np.fromiter(counts.values(), float, len(counts)), 2), WORDS + SHAPES)
        again = sum(map(eq, tokens, tokens[1:]))
        if again * 10 > len(tokens):  # more than any text does by chance
            both[-1] += 10.0 * again
        at = np.flatnonzero(both)
        return at, both[at]


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """(documents, documents that have each column), over all documents."""

    def run(batches):
        features, total, n = Features(), np.zeros(WORDS + SHAPES, np.int64), 0
        for b in batches:
            for t in raw(b, text):
                total[features(t)[0]] += 1
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["column", "n"])

    rows = docs.select(text).mapInArrow(run, "column long, n long").groupBy("column").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(WORDS + SHAPES), 0
    for r in rows:
        if r.column < 0:
            n = r.n
        else:
            out[r.column] = r.n
    return n, out


class Model:
    """The latent space and the voters in it."""

    def __init__(self, texts: list[bytes], labels: list[int], share: float, n_docs: int, frequency: np.ndarray):
        self.share, self.labels = share, np.array(labels, float)
        self.idf = np.log((1 + n_docs) / (1 + frequency)) + 0.1
        dense, features = np.zeros((len(texts), WORDS + SHAPES), np.float32), Features()
        for row, t in zip(dense, texts, strict=True):
            at, n = features(t)
            row[at] = self._weights(at, n)
        values, vectors = np.linalg.eigh((dense @ dense.T).astype(np.float64))
        top = [k for k in np.argsort(-values)[:LATENT] if values[k] > 1e-9]
        self.space = (dense.T @ (vectors[:, top] / np.sqrt(values[top]))).astype(np.float32)
        self.voters = self._unit(dense @ self.space)

    def _weights(self, at, n):
        w = np.log1p(n) * self.idf[at]
        for part in (at < WORDS, at >= WORDS):  # words and shapes weigh the same
            w[part] /= max(1e-12, math.sqrt(float(w[part] @ w[part])))
        return w

    @staticmethod
    def _unit(x):
        return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))

    def scores(self, texts, features: Features) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if not len(self.labels) or not self.space.shape[1]:
            return out
        latent = np.zeros((len(texts), self.space.shape[1]), np.float32)
        for row, t in zip(latent, texts, strict=True):
            at, n = features(t)
            if len(at):
                row[:] = self._weights(at, n).astype(np.float32) @ self.space[at]
        some = np.flatnonzero(np.abs(latent).any(axis=1))
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(some), 256):
            own = some[i : i + 256]
            cosine = self._unit(latent[own]) @ self.voters.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** 4
            out[own] = np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0, 1)
        return out


def score(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", id_col: str = "doc_id", text: str = "text", column: str = "score") -> DataFrame:
    """docs with `score`, the share of the vote for label 1; a column of that name is replaced.

    Only the text is an input of a score. Texts that are null, empty or white space score the
    share of label 1 among the rows to learn from, as does every text where no label is known.
    Rows are never merged or dropped; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop(column)
    small_batches(spark)
    n, frequency = document_frequencies(docs, text)
    texts, ys, share = sample(docs, labels, label, learn, id_col, text, PER_CLASS, MAX_BYTES)
    sent = spark.sparkContext.broadcast(vars(Model(texts, ys, share, n, frequency)))

    def run(batches):
        model, features = restored(Model, sent.value), Features()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(raw(b, text), features))], [*b.schema.names, column])

    return docs.mapInArrow(run, StructType(list(docs.schema)).add(column, "double"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: rows whose crc32 of doc_id is 1 modulo 3 are held out of learning."""
    out = score(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
