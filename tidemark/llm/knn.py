r"""Exact top-k search by inner product as a Voronoi kNN join.

Equal vectors are collapsed first, queries likewise. Of what follows k' is k and the most rows that an asking id has (one, where
ids are unique): that many are enough, whichever of them a query has to leave out as its own. A vector keeps its k' smallest
ids. Pivots, drawn by a hash, half the root of the number of vectors but PIVOTS at least and MOST_PIVOTS at most, divide the data into cells and the queries into groups by the nearest pivot. From summaries
of the cells (size, radius, greatest norm, and the exact scores of the pivots, which are data too) come two bounds for a
group g with pivot p and radius r: a threshold that the k'-th score of each of its queries surely reaches, and for each
vector x at most p.x + r |x|. Only vectors whose bound reaches the group's threshold are sent to it. Neighbouring groups share
a bin of up to BLOCK queries, to which a vector goes once if it matters to any of them: where distances don't tell vectors
apart, and so no bound prunes, the data is sent as often as there are blocks of queries, not once a group. Bins are solved
locally, BLOCK queries against a salted share of the vectors, and the shares' best are merged.

Components are turned into integers by a caller's scale, so scores are exact: sums below 2**53 are taken in float64, others
in Python's integers. Defined results: vectors that are null, or hold null or non-finite components, and rows without an id
take no part; vectors of different lengths don't score against each other; ties go to the smaller id; rows that repeat an id
are vectors of their own, each a query, but no query finds its own id; a query with no candidates has no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from tidemark.session import ship

from .common import by_batch, cut

PIVOTS, MOST_PIVOTS, BLOCK, SHARE = 48, 2048, 2048, 8_000


def usable(vector: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def _exact(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Integer inner products of int64 rows, as int64, or as objects where int64 can't hold them."""
    most = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(others.astype(float)).max(initial=0)) * max(1, vectors.shape[1])
    if most < 2**53:
        return (vectors.astype(float) @ others.astype(float).T).astype(np.int64)
    return vectors.astype(object) @ others.astype(object).T


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0, square))


#: Bounds in float64 are widened by this share of the magnitudes, far above rounding.
_SLACK = 1e-9


def _placed(pivots: np.ndarray, k: int):
    """Cell, distance to its pivot, and the k-th best exact-up-to-rounding score against the pivots, for each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(0), pivots.shape[1]).astype(float)
            far, score = _distances(x, pivots), np.sort(x @ pivots.T, axis=1)
            cell = far.argmin(axis=1)
            low = score[:, -k] if score.shape[1] >= k else np.full(len(x), -np.inf)
            columns = [*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(x)), cell]), pa.array(low)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cell", "far", "low"])

    return run


def _bins(pivots: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Groups packed into bins of BLOCK queries, neighbours together; a larger group has a bin of its own."""
    center = pivots - pivots.mean(axis=0)
    axis = np.linalg.svd(center, full_matrices=False)[2][0] if center.size else np.zeros(pivots.shape[1])
    bins, current, load = np.zeros(len(pivots), int), 0, 0
    for g in np.argsort(center @ axis, kind="stable"):
        if load and load + size[g] > BLOCK:
            current, load = current + 1, 0
        bins[g] = current
        load += size[g]
    return bins


def _replicated(pivots: np.ndarray, radius: np.ndarray, threshold: np.ndarray, bins: np.ndarray):
    """A row for each bin that a vector may matter to: those with a group where its bound reaches the threshold."""
    members = np.zeros((len(bins), bins.max() + 1), np.float32)
    members[np.arange(len(bins)), bins] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(0), pivots.shape[1]).astype(float)
            norm = np.sqrt((x * x).sum(1))
            reach = radius[None, :] * norm[:, None]
            bound = x @ pivots.T + reach
            matters = bound + _SLACK * (np.abs(bound) + reach + 1) >= threshold[None, :]
            near, to = np.nonzero(matters.astype(np.float32) @ members > 0)
            take = pa.array(near, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(to, pa.int32())], names=["v", "ids", "bin"])

    return run


def _solved(k: int):
    """The k best (score, id) of each query among the vectors of its block."""

    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({"v": [], "score": [], "id": []})
        q, x = np.stack(queries["v"].to_numpy()), np.stack(data["v"].to_numpy())
        length = np.array([len(i) for i in data["ids"]])
        ids, owner = np.concatenate(data["ids"].to_numpy()), np.repeat(np.arange(len(x)), length)
        out = []
        for start in range(0, len(q), 256):
            scores = _exact(q[start : start + 256], x)
            for row, s in enumerate(scores):
                if len(s) > k:
                    if s.dtype == object:
                        least = sorted(s.tolist())[-k]
                    else:
                        least = np.partition(s, len(s) - k)[len(s) - k]
                    # every vector that ties with the k-th stays: its ids may be smaller
                    keep = (s >= least)[owner]
                else:
                    keep = np.ones(len(owner), bool)
                best = sorted(zip((-int(a) for a in s[owner[keep]]), ids[keep].tolist()))[:k]
                out += [(queries["v"].iloc[start + row], str(-a), i) for a, i in best]
        return pd.DataFrame(out, columns=["v", "score", "id"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, pivots: int | None = None) -> DataFrame:
    """query_id, rank (from 1), id_col, score: the k highest inner products of each query with rows of other ids.

    A component x counts as floor(scale * x), x taken as double.
    """
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = cut(rows, "vectors")
    out = None
    for dim in sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect()):
        found = _of_length(rows.where(F.size("v") == dim), dim, k, pivots)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    return out.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _of_length(rows: DataFrame, dim: int, k: int, n_pivots: int | None) -> DataFrame:
    asking = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks")).where("asks")
    enough = k + (asking.agg(F.max("n")).first()[0] or 1)
    # A limit on row_number is applied in each task before the shuffle, so one very common vector is no hot key.
    first = Window.partitionBy("v").orderBy("id")
    least = rows.select("v", "id").distinct().withColumn("at", F.row_number().over(first)).where(F.col("at") <= enough)
    data = cut(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct-vectors")
    n_pivots = n_pivots or min(MOST_PIVOTS, max(PIVOTS, math.isqrt(data.count()) // 2))
    if dim == 0:
        drawn = [[]]
    else:
        drawn = [r["v"] for r in data.orderBy(F.xxhash64("v"), "v").limit(n_pivots).select("v").collect()]
    centers = np.array(drawn, float).reshape(len(drawn), dim)
    asked = rows.where("asks").select("v").distinct()
    queries = cut(by_batch(asked, _placed(centers, enough), "v array<bigint>, cell int, far double, low double"), "queries")
    # Of each group: its radius, and the least of its queries' thresholds. The pivots are distinct vectors of the data, so a
    # query's k'-th score against them bounds its k-th against all others from below.
    radius, threshold, size = np.zeros(len(centers)), np.full(len(centers), np.inf), np.zeros(len(centers), int)
    for r in queries.groupBy("cell").agg(F.max("far").alias("r"), F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], threshold[r["cell"]], size[r["cell"]] = r["r"], r["low"] - _SLACK * (abs(r["low"]) + 1), r["n"]
    bins = _bins(centers, size)
    sent = cut(by_batch(data, _replicated(centers, radius, threshold, bins), "v array<bigint>, ids array<bigint>, bin int"), "sent")
    load = {r["bin"]: r["count"] for r in sent.groupBy("bin").count().collect()}
    blocks = np.maximum(1, -(-np.bincount(bins, weights=size).astype(int) // BLOCK))
    salts = np.array([max(1, -(-load.get(c, 0) // SHARE)) for c in range(len(blocks))])
    of = lambda table, col: F.element_at(F.array(*(F.lit(int(n)) for n in table)), F.col(col) + 1)
    q = queries.select("v", of(bins, "cell").alias("bin")).withColumn("block", F.pmod(F.xxhash64("v"), of(blocks, "bin")).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), of(salts, "bin") - 1)))
    x = sent.withColumn("salt", F.pmod(F.xxhash64("v", F.lit("salt")), of(salts, "bin")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), of(blocks, "bin") - 1)))
    ship(rows.sparkSession)
    best = q.groupBy("bin", "block", "salt").cogroup(x.groupBy("bin", "block", "salt")).applyInPandas(_solved(enough), "v array<bigint>, score string, id long")
    asks = rows.where("asks").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    pairs = asks.join(best, F.col("qv") == F.col("v")).where("query_id <> id").select("query_id", "id", F.col("score").cast("decimal(38,0)").alias("score")).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("score").cast("long").alias("score"))
