"""Write paths as table transforms: what a write adds to the append-only log of fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.overlay import split_stripes, stripe_of
from tidemark.plans.ordered import row_numbers
from tidemark.schemas import STRIPE_BYTES, TIER_HOT


def append(writes: DataFrame, base_seq: int, stripe: int = STRIPE_BYTES, tier: int = TIER_HOT) -> DataFrame:
    """Writes (arrival, inode, logical_off, length, segment_id, segment_offset) as fragments: split at stripes, a fresh seq
    from base_seq for each piece in order of arrival and offset. Empty writes add nothing."""
    pieces = split_stripes(writes, stripe)
    numbered = row_numbers(pieces, ["arrival", "logical_off"], "seq", base_seq)
    return numbered.select("inode", "stripe_id", "seq", "logical_off", "length", F.lit(tier).cast("tinyint").alias("tier"), "segment_id", "segment_offset")


def append_batch(extents: DataFrame, stripe: int = STRIPE_BYTES) -> DataFrame:
    """The caller's extents (fragments with their own seqs), each checked to lie in one stripe as it is read."""
    last = F.col("logical_off") + F.col("length") - 1
    bad = (F.col("length") > 0) & (stripe_of(F.col("logical_off"), stripe) != stripe_of(last, stripe))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("extent crosses a stripe at "), F.col("logical_off").cast("string"))).cast("long")).otherwise(F.col("length"))
    return extents.withColumn("length", checked).where("length > 0")


def straddling(extents: DataFrame, stripe: int = STRIPE_BYTES) -> DataFrame:
    """The extents that append_batch() would refuse."""
    return extents.where((F.col("length") > 0) & (stripe_of(F.col("logical_off"), stripe) != stripe_of(F.col("logical_off") + F.col("length") - 1, stripe)))


class BulkSession:
    """Staged writes that nobody sees until commit, when they get their seqs; abort drops them."""

    def __init__(self, stripe: int = STRIPE_BYTES, tier: int = TIER_HOT) -> None:
        self.stripe, self.tier, self.staged = stripe, tier, None

    def write(self, writes: DataFrame) -> None:
        self.staged = writes if self.staged is None else self.staged.unionByName(writes)

    def commit(self, fragments: DataFrame, base_seq: int) -> DataFrame:
        """fragments with what was staged behind them."""
        if self.staged is None:
            return fragments
        staged, self.staged = self.staged, None
        return fragments.unionByName(append(staged, base_seq, self.stripe, self.tier))

    def abort(self) -> None:
        self.staged = None


def grow_nodes(nodes: DataFrame, written: DataFrame, now_ns: int) -> DataFrame:
    """Nodes after a bulk write of fragments: size reaches the furthest end, mtime and ctime are now."""
    ends = written.groupBy("inode").agg(F.max(F.col("logical_off") + F.col("length")).alias("end"))
    joined = nodes.join(ends, "inode", "left")
    touched = F.col("end").isNotNull()
    changed = {"size": F.greatest("size", F.coalesce("end", "size"))} | {c: F.when(touched, F.lit(now_ns)).otherwise(F.col(c)) for c in ("mtime_ns", "ctime_ns")}
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in nodes.columns))


def allocate(rows: DataFrame, order: list[str], first: int, name: str = "inode") -> DataFrame:
    """rows with consecutive ids from first in the order: no shared counter, no task that sees all rows."""
    return row_numbers(rows, order, name, first)
