"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of the characters (code points) of the lower-cased
text, present or not. Their log-count ratios come from the labelled sample by a
distributed count. Those that differ between the classes by TELLING standard errors,
each scaled by its ratio, enter a logistic regression.

The sample holds at most PER_CLASS labelled documents of each class.

Defined results: a null text counts as empty; without labelled documents of both
classes, or without a telling feature, every score is the share of label 1 (0.5
without any); an id with several texts or labels gives one labelled document (see
``labelled_sample``); repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .fuse import mix
from .labelled import labelled_sample

PER_CLASS = 4000
SIZES = (4, 5, 6)
BITS = 20
#: Documents that must hold a feature, and standard errors between its shares in both classes:
#: so many that fewer than one of 2 ** BITS features gets there by chance.
SUPPORT, TELLING = 4, 5.0
#: Added count; strength of regularisation; steps of the regression.
ALPHA, RIDGE, STEPS = 1.0, 0.1, 200
#: Characters that are hashed at a time, and documents that a step multiplies at a time.
PIECE, ROWS_AT_ONCE = 1 << 16, 500

_U = np.uint64


def _grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes, below 2 ** BITS, of the n-grams of some code points."""
    wide = points.astype(_U) + _U(1)
    run = np.zeros(len(points), _U)
    for n in range(1, max(SIZES) + 1):
        if len(points) < n:
            return
        run = run[: len(points) - n + 1] * _U(0x9E3779B97F4A7C15) + wide[n - 1 :]
        if n in SIZES:
            yield (mix(run, n) >> _U(64 - BITS)).astype(np.int64)


def grams(text: str | None, table: np.ndarray | None = None) -> np.ndarray:
    """Distinct features of a whole text; with ``table`` its entries that aren't negative."""
    padded = f" {(text or '').lower()} "
    found = []
    for at in range(0, len(padded), PIECE):
        for h in _grams(np.frombuffer(padded[at : at + PIECE + max(SIZES) - 1].encode("utf-32-le"), np.uint32)):
            if table is not None:
                h = table[h]
                h = h[h >= 0]
            found.append(np.unique(h))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    table: np.ndarray  # feature -> place among the kept ones, or -1
    weights: np.ndarray  # of the kept ones, with their ratios multiplied in
    bias: float

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[grams(text, self.table)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, neg, pos): documents of each class that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for y, x in zip(b.column("label").to_pylist(), b.column("text"), strict=True):
                held[y, grams(x.as_py())] += 1
        every = np.flatnonzero(held.any(axis=0))
        for at in np.split(every, range(1 << 15, len(every), 1 << 15)):
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(held[y, at].astype(np.int64)) for y in (0, 1))], names=["feature", "neg", "pos"])

    parts = sample.select("label", "text").mapInArrow(run, "feature long, neg long, pos long")
    return parts.groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))


def log_ratios(counts: DataFrame, n0: int, n1: int) -> DataFrame:
    """(feature, ratio) of the telling features of ``n0`` and ``n1`` documents of either class."""
    p1, p0 = (F.col("pos") + ALPHA) / (n1 + 2 * ALPHA), (F.col("neg") + ALPHA) / (n0 + 2 * ALPHA)
    pooled = (F.col("pos") + F.col("neg") + ALPHA) / (n0 + n1 + 2 * ALPHA)
    telling = F.abs(p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1) + 1e-12)
    return counts.where((F.col("pos") + F.col("neg") >= SUPPORT) & (telling >= TELLING)).select("feature", F.log(p1 / p0).alias("ratio"))


def _logistic(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a weighted logistic regression, ridge on the weights, by accelerated gradient steps.

    ``rows`` lists the places of the features that each document holds, so the work
    is in proportion to them; ROWS_AT_ONCE documents are multiplied at a time.
    """
    parts = [(at, np.concatenate(rows[at : at + ROWS_AT_ONCE]), np.array([len(r) for r in rows[at : at + ROWS_AT_ONCE]])) for at in range(0, len(rows), ROWS_AT_ONCE)]

    def times(beta: np.ndarray) -> np.ndarray:
        out, scaled = np.empty(len(rows)), np.append(beta[:-1] * ratios, 0.0)
        for at, place, sizes in parts:
            run = np.concatenate([[0.0], np.cumsum(scaled[place])])
            ends = np.cumsum(sizes)
            out[at : at + len(sizes)] = run[ends] - run[ends - sizes]
        return out + beta[-1]

    def back(err: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ratios))
        for at, place, sizes in parts:
            out += np.bincount(place, np.repeat(err[at : at + len(sizes)], sizes), len(ratios))
        return np.append(out * ratios, err.sum())

    ridge = np.append(np.full(len(ratios), RIDGE), 0.0)
    v = np.ones(len(ratios) + 1)
    for _ in range(20):  # the largest curvature bounds the step
        v = back(weight * times(v / np.linalg.norm(v)))
    step = 1 / (0.3 * np.linalg.norm(v) + RIDGE)
    beta, seen = np.zeros(len(ratios) + 1), np.zeros(len(ratios) + 1)
    for t in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(times(seen), -40, 40)))
        new = seen - step * (back(weight * (p - y)) + ridge * seen)
        beta, seen = new, new + (new - beta) * (t / (t + 3))
    return beta[:-1], float(beta[-1])


def train(documents: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A model of ``label`` from labels that are ``usable``."""
    sample, known = labelled_sample(documents, labels, label, usable, per_class)
    total = sum(known.values())
    prior = known.get(1, 0) / total if total else 0.5
    flat = float(np.clip(prior, 1e-6, 1 - 1e-6))
    constant = Model(np.full(1 << BITS, -1, np.int32), np.zeros(0), float(np.log(flat / (1 - flat))))
    if not known.get(0) or not known.get(1):
        return constant
    sample = durable(sample, "labelled")
    n0, n1 = (min(per_class, known[y]) for y in (0, 1))
    # At most 16 bytes for each place of the hash table.
    kept = log_ratios(_counts(sample), n0, n1).toArrow().sort_by("feature")
    if not kept.num_rows:
        return constant
    table = np.full(1 << BITS, -1, np.int32)
    table[kept["feature"].to_numpy()] = np.arange(kept.num_rows)
    ratios = kept["ratio"].to_numpy()
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [grams(x.as_py(), shared.value).astype("<i4").tobytes() for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(rows, pa.binary())], names=["id", "label", "found"])

    # One row for each document of the sample: the places of its telling features.
    found = sample.select("id", "label", "text").mapInArrow(run, "id long, label int, found binary").collect()
    found.sort(key=lambda r: r["id"])
    y = np.array([r["label"] for r in found], float)
    # Classes weigh as among all labels, so that scores are probabilities.
    weight = np.where(y == 1, prior * len(y) / n1, (1 - prior) * len(y) / n0)
    beta, bias = _logistic([np.frombuffer(r["found"], "<i4") for r in found], y, ratios, weight)
    return Model(table, beta * ratios, bias)


def toxicity(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.array([shared.value.score(x.as_py()) for x in b.column(1)], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose text isn't toxic, with the input's columns; no row moves.

    A model that learned no feature tells no texts apart, so it rejects none.
    """
    if not len(model.weights):
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) < 0.5 for t in texts], dtype=bool)

    return documents.where(clean(F.col(text_col).cast("string")))
