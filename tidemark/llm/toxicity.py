"""Toxicity as ordered severity, by cumulative-link regression on sparse text features.

P(grade > k) = sigmoid(w . x - theta_k): one weight vector for all thresholds theta_0 < theta_1 < ..., so the grades are
ordered along one axis. x marks which hashed features a text has: its words and their first four and five letters. The
weights are fitted here by Adam on the negative log-likelihood with soft thresholding, which leaves most of them at zero.
The fit takes a bounded sample of whole texts: at most DOCS_A_GRADE labelled documents of each grade, and SAMPLE of all, drawn
by a hash of doc_id. Every grade that has a label is learned, however many there are.
A document's severity is its expected grade.

Defined results: a null or empty text, or one without known features, gets what the thresholds alone give; labels that are
null are left out and a document labelled twice has its highest grade; grades are ranked by value; with fewer than two
grades the severity is the only grade (0 without labels); repeated rows each get a result; an empty table an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, by_batch, drawn

DOCS_A_GRADE, SAMPLE = 2000, 8000
BUCKETS, LEAST_DOCS = 1 << 20, 4
STEPS, RATE, L1 = 150, 0.05, 2e-4
_WORD = re.compile(r"[^\W_]+")
_KEPT = 200_000


def features_of(word: str) -> tuple[int, ...]:
    parts = {f"w{word}"} | {f"p{word[:k]}" for k in (4, 5) if len(word) >= k}
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of a text, sorted."""
    return np.unique(np.fromiter((b for w in set(_WORD.findall((text or "").lower())) for b in features_of(w)), np.int32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Ordinal:
    #: The label values in order; grade k stands for values[k].
    values: list[float]
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, values: list[float], steps: int = STEPS, l1: float = L1) -> Ordinal:
        """rows: feature buckets of each document; y: its grade as an index into values. Each grade has the same weight."""
        buckets, counts = np.unique(np.concatenate(rows), return_counts=True) if rows else (np.empty(0, np.int32), np.empty(0))
        buckets = buckets[counts >= LEAST_DOCS]
        at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)])
        column = np.searchsorted(buckets, flat := np.concatenate(rows))
        known = buckets[np.minimum(column, len(buckets) - 1)] == flat if len(buckets) else np.zeros(len(flat), bool)
        at, column = at[known], column[known]
        k = len(values) - 1
        share = 1 / (np.bincount(y, minlength=k + 1) * (k + 1))
        weight = share[y]
        # thresholds are theta_0 and the logarithms of the steps above it, so they stay in order
        w, p = np.zeros(len(buckets)), np.concatenate([[0.0], np.zeros(k - 1)])
        m, v = np.zeros(len(w) + k), np.zeros(len(w) + k)
        for t in range(1, steps + 1):
            theta = np.cumsum(np.concatenate([p[:1], np.exp(p[1:])]))
            score = np.bincount(at, weights=w[column], minlength=len(rows)) if len(w) else np.zeros(len(rows))
            above = np.concatenate([np.ones((len(rows), 1)), _sigmoid(score[:, None] - theta), np.zeros((len(rows), 1))], axis=1)
            i = np.arange(len(rows))
            chance = np.maximum(above[i, y] - above[i, y + 1], 1e-12)
            slope = above * (1 - above)
            d_score = -weight * (slope[i, y] - slope[i, y + 1]) / chance
            d_theta = np.zeros(k + 2)
            np.add.at(d_theta, y, weight * slope[i, y] / chance)
            np.add.at(d_theta, y + 1, -weight * slope[i, y + 1] / chance)
            d_theta = np.cumsum(d_theta[1:-1][::-1])[::-1]
            d_p = d_theta * np.concatenate([[1.0], np.exp(p[1:])])
            g = np.concatenate([np.bincount(column, weights=d_score[at], minlength=len(w)), d_p])
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            scale = RATE / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            step = scale * m / (1 - 0.9**t)
            w = w - step[: len(w)]
            w = np.sign(w) * np.maximum(0, np.abs(w) - np.minimum(scale[: len(w)] * l1, 0.01))
            p = p - step[len(w) :]
        some = np.flatnonzero(w)
        return cls(values, buckets[some], w[some], np.cumsum(np.concatenate([p[:1], np.exp(p[1:])])))

    def chances(self, score: np.ndarray) -> np.ndarray:
        above = np.concatenate([np.ones((len(score), 1)), _sigmoid(score[:, None] - self.thresholds), np.zeros((len(score), 1))], axis=1)
        return above[:, :-1] - above[:, 1:]


class _Known(dict):
    """A word's features that have weights, as a map of bucket to weight; most words have none."""

    def __init__(self, model: Ordinal) -> None:
        self.weights = dict(zip(model.buckets.tolist(), model.weights.tolist()))

    def __missing__(self, word: str) -> dict[int, float] | None:
        if len(self) >= _KEPT:
            self.clear()
        self[word] = found = {b: self.weights[b] for b in features_of(word) if b in self.weights} or None
        return found


def _scored(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model)
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part, scores = batch.slice(k, 1024), []
                for text in part.column(1):
                    has: dict[int, float] = {}
                    for found in map(known.__getitem__, set(_WORD.findall((text.as_py() or "").lower()))):
                        if found:
                            has |= found
                    scores.append(sum(has[b] for b in sorted(has)))
                chances = model.chances(np.array(scores, float))
                severity = chances @ np.array(model.values)
                grade = np.array(model.values)[chances.argmax(axis=1)]
                columns = [part.column(0), pa.array(severity), pa.array(grade), pa.array(list(chances), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "severity", "grade", "chances"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_a_grade: int = DOCS_A_GRADE) -> Ordinal:
    graded = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("double")).alias("label"))
    counts = bounded(graded.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "grades")
    values = sorted(r["label"] for r in counts.select("label").collect())
    if len(values) < 2:
        return Ordinal(values * 2 or [0.0, 0.0], np.empty(0, np.int32), np.empty(0), np.zeros(1))
    sample = drawn(graded, counts, "label", max(1, min(docs_a_grade, SAMPLE // len(values))), "grade")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["label", "features"])

    found = by_batch(rows.select("label", "text"), shown, "label double, features array<int>").toPandas()
    found = sorted(((float(a), np.asarray(b, np.int32)) for a, b in zip(found["label"], found["features"])), key=lambda x: (x[0], len(x[1]), x[1].tobytes()))
    seen = sorted({a for a, _ in found})
    if len(seen) < 2:
        return Ordinal(seen * 2 or values[:1] * 2, np.empty(0, np.int32), np.empty(0), np.zeros(1))
    return Ordinal.fit([b for _, b in found], np.array([seen.index(a) for a, _ in found]), seen)


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, severity (the expected grade), grade (the likeliest), chances (of each grade in order)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = by_batch(rows, _scored(model), f"id {kind}, severity double, grade double, chances array<double>")
    return out.select(F.col("id").alias(id_col), "severity", "grade", "chances")
