"""Quality by nearest-neighbour voting over labelled latent-semantic vectors.

A text becomes a vector of term weights: shapes of four characters, hashed
character trigrams and statistics of its words. A truncated singular value
decomposition of the labelled sample gives latent axes. Every document is
compared with every labelled vector by blocked cosine products; its NEIGHBOURS
nearest vote for their labels, weighed by similarity.

The sample holds at most PER_CLASS labelled documents of each class, so the
vectors and axes that are broadcast take about two megabytes, and the terms that
the driver gathers to find the axes 12 kB a labelled document.

Defined results: a null text counts as empty; without labelled documents every
score is 0.5, with labels of one class it is that class; an id with several texts or
labels gives one labelled document (see ``labelled_sample``); repeated rows repeat;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .near import word_hashes

PER_CLASS = 1500
SHAPES, TRIGRAMS, STATS = 4096, 2048, 96
WIDTH = SHAPES + TRIGRAMS + STATS
AXES, NEIGHBOURS = 48, 25
#: A vote weighs its cosine to this power.
SHARP = 8
#: Bytes whose terms are counted at a time, and documents that are compared at a time.
PIECE, BLOCK = 1 << 20, 256

_U = np.uint64
# Classes of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 space, 5 line end, 6 stop or comma, 7 beyond ASCII
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]], _CLASS[[44, 46]], _CLASS[128:] = 1, 2, 3, 4, 5, 6, 7


def _bins(value: float, n: int) -> np.ndarray:
    """A value from 0 to 1 spread over the two bins around it."""
    out, x = np.zeros(n), min(max(value, 0.0), 1.0) * (n - 1)
    low = min(int(x), n - 2)
    out[low], out[low + 1] = low + 1 - x, x - low
    return out


def terms(text: str | None) -> np.ndarray:
    """Term weights of a whole text: square roots of shares, by group of terms."""
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    shapes, trigrams = np.zeros(SHAPES), np.zeros(TRIGRAMS)
    for at in range(0, len(raw), PIECE):
        b = raw[at : at + PIECE + 3]
        c = _CLASS[b]
        if len(c) >= 4:
            shapes += np.bincount(((c[:-3] * 8 + c[1:-2]) * 8 + c[2:-1]) * 8 + c[3:], minlength=SHAPES)
        if len(b) >= 3:
            w = b.astype(np.uint32)
            h = ((w[:-2] << 16 | w[1:-1] << 8 | w[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(21)
            trigrams += np.bincount(h, minlength=TRIGRAMS)
    words = word_hashes(text)
    n = len(words)
    if n:
        _, times = np.unique(words, return_counts=True)
        distinct, top, again = len(times) / n, times.max() / n, float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0
        stats = [_bins(distinct, 16), _bins(top, 16), _bins(again, 16), _bins(np.log2(n + 1) / 16, 16), _bins(len(raw) / n / 16, 16), _bins(float((_CLASS[raw] == 0).mean()) * 4, 16)]
    else:
        stats = [np.zeros(16)] * 6
    norm = lambda x: np.sqrt(x / x.sum()) if x.sum() else x
    return np.concatenate([norm(shapes), norm(trigrams), np.concatenate(stats) / 2]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray  # of terms
    axes: np.ndarray  # (terms, AXES), weights multiplied in
    vectors: np.ndarray  # (AXES, labelled)
    votes: np.ndarray  # of each labelled vector, so that classes weigh as among all labels
    labels: np.ndarray
    prior: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts or not len(self.labels):
            return np.full(len(texts), self.prior)
        latent = _unit(np.stack([terms(t) for t in texts]) @ self.axes)
        k = min(NEIGHBOURS, len(self.labels))
        cosine = latent @ self.vectors
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-3).astype(float) ** SHARP * self.votes[near]
        return np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _latent_axes(x: np.ndarray, axes: int) -> np.ndarray:
    """Leading right singular vectors, by a randomised range of fixed seed."""
    k = min(axes, *x.shape)
    rng = np.random.Generator(np.random.PCG64(7))
    y = x @ rng.standard_normal((x.shape[1], min(k + 16, min(x.shape)))).astype(np.float32)
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:k].T


def train(documents: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """A model of ``label`` from labels that are ``usable``."""
    sample, known = labelled_sample(documents, labels, label, usable, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [terms(x.as_py()).astype(np.float16).tobytes() for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), part.column("label"), pa.array(rows, pa.binary())], names=["id", "h", "label", "terms"])

    # At most 2 * per_class rows of WIDTH half-precision numbers.
    rows = sample.select("id", "h", "label", "text").mapInArrow(run, "id long, h long, label int, terms binary").collect()
    rows.sort(key=lambda r: (r["h"], r["id"]))
    total = sum(known.values())
    prior = known.get(1, 0) / total if total else 0.5
    if not rows:
        empty = np.zeros((0, 0), np.float32)
        return Model(np.zeros(0), empty, empty, np.zeros(0), np.zeros(0), prior)
    x = np.stack([np.frombuffer(r["terms"], np.float16) for r in rows]).astype(np.float32)
    y = np.array([r["label"] for r in rows])
    weights = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    axes = _latent_axes(x * weights, AXES).astype(np.float32) * weights[:, None]
    share = np.bincount(y, minlength=2) / len(y)
    votes = np.array([(prior if c else 1 - prior) / share[c] for c in y])
    return Model(weights, axes, np.ascontiguousarray(_unit(x @ axes).T), votes, y.astype(float), prior)


def quality(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                score = shared.value.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
