"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.plans.groups import by_batch, grouped
from tidemark.session import settle

#: What separates words; a word is a run of ASCII letters and digits and of anything beyond ASCII.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


cut = settle


#: What is broadcast has at most so many rows of a few numbers, as counted; an array counts by its elements.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, tag: str, array: str | None = None) -> DataFrame:
    """df cut, and marked for broadcast if it counts no more than BROADCAST_ROWS, so that what it joins isn't shuffled."""
    df = cut(df, tag)
    n = df.count() if array is None else df.agg(F.sum(F.size(array) + 1)).first()[0] or 0
    if n > BROADCAST_ROWS:
        return df
    out = F.broadcast(df)
    out._tidemark_path = df._tidemark_path
    return out


def drawn(rows: DataFrame, counts: DataFrame, by: str, quota: int, seed: str) -> DataFrame:
    """rows (id, by), of each class at most quota, drawn by a hash of the id; counts (by, n) are the sizes of the classes.

    The rank within a class is only taken among the first 1.25 times quota or so of its hashes, so no task sorts a class.
    """
    spot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    few = rows.join(counts, by).where(spot * F.col("n") < (1.25 * quota + 20) * float(1 << 30))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(spot, "id"))
    return few.withColumn("rank", rank).where(F.col("rank") <= quota).select(*rows.columns)


def word_array(text: Column) -> Column:
    """The lower-cased words; none if text is null. Splitting costs half of what extracting the words does."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NO_WORD), "")


def by_group(df: DataFrame, n_keys: int, run: Callable, schema: str) -> DataFrame:
    """run on the rows of each key (the first n_keys columns) as one Arrow batch, which gives a batch or None."""

    def stream(batches):
        yield from (found for group in grouped(batches, n_keys) if (found := run(group)) is not None)

    keys = df.columns[:n_keys]
    return by_batch(df.repartition(*keys).sortWithinPartitions(*keys), stream, schema)


def add(df: DataFrame, **columns: Column) -> DataFrame:
    """Working columns; their names start with __tm_ so that no column of a caller clashes."""
    return df.withColumns({f"__tm_{k}": v for k, v in columns.items()})


def own(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__tm_")]
