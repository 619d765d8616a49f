r"""Mixing sources to target weights with soft domain membership.

A softmax classifier, fitted here on the labelled table, gives each document a posterior p over domains. Then nonnegative
rates r (expected copies) are fitted so that each domain's expected tokens, the sum over documents of r * tokens * p, match
its target share of the token budget. The fit is accelerated projected gradient descent on least squares: the residual of
the D domains is measured in the metric of their second moments, so one step of length 1 solves the problem wherever no rate
is held at 0, and a term RIDGE keeps rates near 1 where targets leave them free. A document's rate depends on its own tokens
and posterior and on the D-vector of each round alone: each round is one aggregation to D sums, and rates are folded from
the list of those vectors, so nothing about documents is gathered or carried along.

The classifier takes a bounded sample, at most DOCS_A_DOMAIN documents of each label and SAMPLE of all, drawn by a hash; every
label is a domain, however many there are. Sums cover all rows.

Defined results: null and empty texts have 0 tokens, the prior's posterior and a rate like any other; null labels are left
out, a document labelled twice has its greatest label; domains without a labelled document get no share (targets are
scaled to the others); without labels all rates are 1; repeated rows count each; an empty table gives an empty result; a
kept column called n_tokens, posterior or rate gives way to the new one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, by_batch, cut, drawn
from .toxicity import _WORD, features, features_of

DOCS_A_DOMAIN, SAMPLE = 1500, 12_000
LEAST_DOCS, STEPS, RATE, L1 = 4, 120, 0.05, 2e-4
ROUNDS, CLOSE, RIDGE, _KEPT = 60, 1e-6, 1e-6, 200_000


@dataclass
class Softmax:
    domains: list[str]
    buckets: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, domains: list[str]) -> Softmax:
        """Adam on the mean cross-entropy with soft thresholding of the weights."""
        buckets, counts = np.unique(np.concatenate(rows), return_counts=True)
        buckets = buckets[counts >= LEAST_DOCS]
        at, flat = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)]), np.concatenate(rows)
        column = np.searchsorted(buckets, flat)
        known = buckets[np.minimum(column, len(buckets) - 1)] == flat if len(buckets) else np.zeros(len(flat), bool)
        at, column = at[known], column[known]
        n, d, b = len(rows), len(domains), len(buckets)
        w, m, v = (np.zeros((b + 1, d)) for _ in range(3))
        one_hot = np.eye(d)[y]
        for t in range(1, STEPS + 1):
            score = np.stack([np.bincount(at, weights=w[column, k], minlength=n) for k in range(d)], axis=1) + w[-1]
            off = (_softmax(score) - one_hot) / n
            g = np.concatenate([np.stack([np.bincount(column, weights=off[at, k], minlength=b) for k in range(d)], axis=1), off.sum(axis=0)[None]])
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            scale = RATE / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            w -= scale * m / (1 - 0.9**t)
            w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - np.minimum(scale[:-1] * L1, 0.01))
        some = np.flatnonzero(np.abs(w[:-1]).sum(axis=1))
        return cls(domains, buckets[some], w[some], w[-1])


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


class _Known(dict):
    """A word's rows of the weight matrix; most words have none."""

    def __init__(self, model: Softmax) -> None:
        self.at = {b: k for k, b in enumerate(model.buckets.tolist())}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= _KEPT:
            self.clear()
        self[word] = found = tuple(self.at[b] for b in features_of(word) if b in self.at)
        return found


def _members(model: Softmax):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(model)
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                tokens, scores = [], np.tile(model.bias, (len(part), 1))
                for i, text in enumerate(part.column(part.num_columns - 1)):
                    words = _WORD.findall((text.as_py() or "").lower())
                    tokens.append(len(words))
                    if has := sorted({j for found in map(known.__getitem__, set(words)) for j in found}):
                        scores[i] += model.weights[has].sum(axis=0)
                columns = [*part.columns[:-1], pa.array(tokens, pa.int64()), pa.array(list(_softmax(scores)), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[:-1], "tokens", "p"])

    return run


def fit_classifier(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, domain_col: str) -> Softmax | None:
    graded = labelled.where(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(domain_col).cast("string")).alias("domain"))
    counts = bounded(graded.groupBy("domain").agg(F.count(F.lit(1)).alias("n")), "domains")
    sample = drawn(graded, counts, "domain", max(1, min(DOCS_A_DOMAIN, SAMPLE // max(1, counts.count()))), "mix")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id").groupBy("id", "domain").agg(F.min("text").alias("text"))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["domain", "features"])

    found = by_batch(rows.select("domain", "text"), shown, "domain string, features array<int>").toPandas()
    found = sorted(((a, np.asarray(b, np.int32)) for a, b in zip(found["domain"], found["features"])), key=lambda x: (x[0], len(x[1]), x[1].tobytes()))
    if not found:
        return None
    domains = sorted({a for a, _ in found})
    index = {d: k for k, d in enumerate(domains)}
    return Softmax.fit([b for _, b in found], np.array([index[a] for a, _ in found]), domains)


@dataclass
class Fit:
    """What rates are folded from: the whitened residual of each round."""

    inverse: np.ndarray
    steps: list[np.ndarray] = field(default_factory=list)

    def fold(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates after all steps, and where the next gradient is to be taken."""
        rate = ahead = np.ones(len(p))
        momentum = 1.0
        for e in self.steps:
            before = rate
            rate = np.maximum(0, ahead - (p @ e + RIDGE * (ahead - 1)) / (1 + RIDGE))
            following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            ahead = rate + (momentum - 1) / following * (rate - before)
            momentum = following
        return rate, ahead


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: Fit, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, p = batch.column(0).to_numpy(zero_copy_only=False).astype(float), _matrix(batch.column(1), d)
            rate, ahead = fit.fold(p)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(p.T @ (t * ahead)), pa.array(p.T @ (t * rate))], names=["d", "ahead", "rate"])

    return run


def _moments(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, p = batch.column(0).to_numpy(zero_copy_only=False).astype(float), _matrix(batch.column(1), d)
            yield pa.RecordBatch.from_arrays([pa.array(range(d * d), pa.int32()), pa.array(((p * t[:, None]).T @ p).ravel())], names=["d", "x"])

    return run


def fit_rates(members: DataFrame, d: int, targets: np.ndarray, rounds: int = ROUNDS) -> tuple[Fit, np.ndarray]:
    """The fit for tokens and p of members, and the domains' shares it reaches; targets are shares of all tokens."""
    two = members.select("tokens", "p")
    moments = np.zeros(d * d)
    for r in by_batch(two, _moments(d), "d int, x double").groupBy("d").agg(F.sum("x").alias("x")).collect():
        moments[r["d"]] = r["x"]
    total = moments.sum()  # posteriors sum to 1, so this is the number of tokens
    if not total:
        return Fit(np.zeros((d, d))), np.zeros(d)
    fit = Fit(np.linalg.pinv(moments.reshape(d, d) / total, rcond=1e-9, hermitian=True))
    for _ in range(rounds):
        ahead, reached = np.zeros(d), np.zeros(d)
        for r in by_batch(two, _sums(fit, d), "d int, ahead double, rate double").groupBy("d").agg(F.sum("ahead").alias("ahead"), F.sum("rate").alias("rate")).collect():
            ahead[r["d"]], reached[r["d"]] = r["ahead"] / total, r["rate"] / total
        if np.abs(reached - targets).max() < CLOSE:
            break
        fit.steps.append(fit.inverse @ (ahead - targets))
    return fit, reached


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", keep: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The columns keep (id_col alone, if None) with n_tokens, posterior (a map by domain) and rate behind them."""
    keep = [c for c in ([id_col] if keep is None else keep) if c not in ("n_tokens", "posterior", "rate")]
    model = fit_classifier(docs, labelled, id_col, text_col, domain_col) or Softmax(["all"], np.empty(0, np.int32), np.empty((0, 1)), np.zeros(1))
    kinds = {f"c{k}": docs.schema[c].dataType.simpleString() for k, c in enumerate(keep)}
    rows = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(keep)), F.col(text_col).cast("string").alias("seen"))
    members = cut(by_batch(rows, _members(model), ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", tokens long, p array<double>"), "members")
    d = len(model.domains)
    share = np.array([max(0.0, targets.get(x, 0.0)) for x in model.domains])
    share = share / share.sum() if share.sum() else np.full(d, 1 / d)
    fit = fit_rates(members, d, share, rounds)[0] if d > 1 else Fit(np.zeros((d, d)))

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, _ = fit.fold(_matrix(batch.column(batch.num_columns - 1), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "rate"])

    out = by_batch(members, rated, members._jdf.schema().toDDL() + ", rate DOUBLE")
    posterior: Column = F.map_from_arrays(F.array(*(F.lit(x) for x in model.domains)), F.col("p"))
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(keep)), F.col("tokens").alias("n_tokens"), posterior.alias("posterior"), "rate")
