"""Key by key through a sorted stream of Arrow batches, without a call or a frame of its own for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import ship


def by_batch(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow, with this package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def together(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """df with all rows of a key in one partition, sorted by the keys and then the order: what a run of by_batch relies on.

    The exchange is by a hash of the keys. One by the keys themselves is left out by the planner behind a join on them, and
    if that join turns into a broadcast while it runs, its rows stay where they were read: a key lies in several partitions.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def starts_of(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Where the first n_keys columns differ from the row before; the first row always counts."""
    change = np.zeros(len(batch), bool)
    change[0] = True
    for k in range(n_keys):
        c = batch.column(k).to_numpy(zero_copy_only=False)
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each key (the first n_keys columns; null-free and sorted) as one batch; it holds one key at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        starts = starts_of(batch, n_keys).tolist()
        key = lambda i: tuple(batch.column(k)[i].as_py() for k in range(n_keys))
        for s, e in zip(starts, [*starts[1:], len(batch)]):
            if held and (s or key(0) != last):
                yield held[0] if len(held) == 1 else pa.concat_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
        last = key(len(batch) - 1)
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)
