"""A quality classifier by nearest-neighbour votes in a latent-semantic space."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Half of the hashed features are words, half are word shapes.
FEATURES = 4096
HALF = FEATURES // 2
REPEATED = FEATURES - 1
SHAPE_WEIGHT = 3.0
_RUN = re.compile(r"(.)\1+", re.DOTALL)
REMEMBERED = 300_000


class _Classes(dict):
    """A character's class, for ``str.translate``: letters x or X, digits 9, others themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        value = self[code] = ("X" if c.isupper() else "x") if c.isalpha() else "9" if c.isdigit() else c
        return value


_CLASSES = _Classes()


def shape(word: str) -> str:
    return _RUN.sub(r"\1", word.translate(_CLASSES))


class Featurizer:
    """text -> counts of hashed features: each word lowered, each word's shape, and
    the mark of a word that repeats the one before."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.long = False
        self.words = self.shapes = np.zeros(0, np.int64)

    def _learn(self, words: set[str]) -> None:
        new = list(words - self.ids.keys())
        if new:
            self.long = any(len(w) > 64 for w in new)  # texts without spaces aren't remembered
            self.ids.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            self.words = np.concatenate([self.words, [crc32(w.lower().encode()) % HALF for w in new]])
            self.shapes = np.concatenate([self.shapes, [HALF + crc32(shape(w).encode()) % (HALF - 1) for w in new]])

    def counts(self, texts: list[str | None]) -> np.ndarray:
        if len(self.ids) > REMEMBERED or self.long:
            self.clear()
        split = [t.split() if t else [] for t in texts]
        self._learn(set().union(*split))
        get = self.ids.__getitem__
        ids = np.fromiter((i for words in split for i in map(get, words)), np.int64)
        sizes = np.array([len(w) for w in split])
        row = np.repeat(np.arange(len(texts)), sizes)
        again = np.flatnonzero((ids[1:] == ids[:-1]) & (row[1:] == row[:-1])) if len(ids) else ids
        base = row * FEATURES
        at = np.concatenate([base + self.words[ids], base + self.shapes[ids], base[again] + REPEATED])
        return np.bincount(at, minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the features
    axes: np.ndarray  # features x rank
    vectors: np.ndarray  # labelled documents x rank, of length 1
    good: np.ndarray  # their labels, 0 or 1
    k: int
    power: float

    def vectors_of(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.log1p(counts) * self.weights) @ self.axes)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """For each row the part of its neighbours' votes that is for quality; NaN without any.

        Cosines to all labelled vectors are exact; the k nearest vote by their
        cosine to a power, and others as near as the k-th (within 1e-6) do too."""
        cosines = self.vectors_of(counts) @ self.vectors.T
        k = min(self.k, cosines.shape[1])
        kth = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, -k, None]
        votes = np.where(cosines >= kth - 1e-6, np.maximum(cosines, 0), 0) ** self.power
        whole = votes.sum(axis=1)
        return np.where(whole > 0, votes @ self.good / np.where(whole > 0, whole, 1), np.nan)


def fit_arrays(counts: np.ndarray, good: np.ndarray, *, rank: int = 32, k: int = 9, power: float = 4.0, seed: int = 7) -> Model:
    """TF-IDF of the labelled rows and its truncated SVD by randomised subspace iteration."""
    n = len(counts)
    weights = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))).astype(np.float32)
    weights[HALF:] *= SHAPE_WEIGHT
    x = _unit(np.log1p(counts) * weights)
    y = x.T @ np.random.default_rng(seed).standard_normal((n, min(rank + 16, n))).astype(np.float32)
    for _ in range(4):
        y = x.T @ (x @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    axes = np.ascontiguousarray(q @ np.linalg.svd(x @ q, full_matrices=False)[2][:rank].T, dtype=np.float32)
    return Model(weights, axes, _unit(x @ axes), good.astype(np.float32), k, power)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 2048, rank: int = 32, k: int = 9) -> Model | None:
    """Fit on at most ``sample`` labelled documents, the bound on what the driver
    holds and every task receives (sample x (FEATURES + rank) floats, whatever the
    texts' lengths): those of least hash of the id, a uniform sample. A label of
    null quality or id is left out; of a document's several labels, and of its
    several texts where an id repeats, the least counts. None if no labelled document
    is there."""
    labelled = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__q"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__q").agg(F.min("text").alias("text"))

    def start():
        feat = Featurizer()

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            values = []
            texts = b.column(2).to_pylist()
            for lo in range(0, len(texts), 64):
                for row in feat.counts(texts[lo : lo + 64]):
                    at = np.flatnonzero(row)
                    values.append((at, row[at]))
            return pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([v[0] for v in values], pa.list_(pa.int32())), pa.array([v[1] for v in values], pa.list_(pa.float32()))],
                ["doc_id", "q", "at", "n"],
            )

        return each

    q = labels.schema["quality"].dataType.simpleString()
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_batches(texts, start, f"doc_id {kind}, q {q}, at array<int>, n array<float>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.at, r.n))
    counts = np.zeros((len(rows), FEATURES), np.float32)
    for i, r in enumerate(rows):
        counts[i, r.at] = r.n
    return fit_arrays(counts, np.array([r.q > 0 for r in rows]), rank=rank, k=k)


def classify(docs: DataFrame, model: Model | None, *, threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """Each row's ``columns`` (doc_id by default), ``score`` and ``keep``.

    The labelled vectors and axes are broadcast (they are of fixed size, see
    ``fit``); documents are scored in blocks against all of them, without a shuffle.
    A document is kept unless less than ``threshold`` of its votes are for quality.
    A null or empty text, or any text no labelled vector is near, gets no votes: a
    null score, and it is kept, as all are if there is no model. Rows that repeat
    are scored alike; null ids stay; an empty table gives none; other columns,
    even of the names score and keep, don't matter.
    """
    columns = columns or ["doc_id"]
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    block = 256

    def start():
        feat, m = Featurizer(), sent.value

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(b.num_columns - 1).to_pylist()
            if m is None:
                scores = np.full(len(texts), np.nan)
            else:
                parts = [texts[i : i + block] for i in range(0, len(texts), block)]
                scores = np.concatenate([m.scores(feat.counts(p)) for p in parts])
            none = np.isnan(scores)
            return pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(scores, pa.float64(), mask=none), pa.array(none | (scores >= threshold))], names
            )

        return each

    names = [*(f"c{i}" for i in range(len(columns))), "score", "keep"]
    kinds = [docs.schema[c].dataType.simpleString() for c in columns]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, [*kinds, "double", "boolean"]))
    given = docs.select(*(F.col(c).alias(n) for c, n in zip(columns, names)), F.col("text").alias("__text"))
    out = map_batches(given, start, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, columns)), "score", "keep")


def kept_documents(docs: DataFrame, model: Model | None, *, threshold: float = 0.5) -> DataFrame:
    """The documents the classifier keeps, with all their columns."""
    scored = classify(docs, model, threshold=threshold, columns=docs.columns)
    keep = scored.columns.index("keep") if "keep" not in docs.columns else len(docs.columns) + 1
    names = [f"c{i}" for i in range(len(scored.columns))]
    flat = scored.toDF(*names)
    return flat.where(F.col(names[keep])).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
