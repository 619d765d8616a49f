"""Newest-wins overlay of versioned byte ranges, and reads planned on it.

Both exchange their input once, by (inode, stripe) or (read, stripe), sort it within partitions, and sweep it in one pass over
Arrow batches that carries its state from row to row: n log n for a key with any number of versions, and no more memory than
the versions that cover one spot. Pieces never cross a stripe, so a large or hot inode, or a long read, is spread over its
stripes; what a read's slices continue across a border is joined up from the slices at borders alone.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.groups import by_batch, together
from tidemark.schemas import SLICE_BYTES, STRIPE_BYTES

KEY = ["inode", "stripe_id"]


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Half-open ranges share a byte."""
    return (start < other_end) & (end > other_start)


def stripe_of(off: Column, stripe: int = STRIPE_BYTES) -> Column:
    return F.floor(off / F.lit(stripe)).cast("long") if stripe & (stripe - 1) else F.shiftright(off, stripe.bit_length() - 1)


def split_stripes(ranges: DataFrame, stripe: int = STRIPE_BYTES) -> DataFrame:
    """One piece for each stripe that a range (logical_off, length, segment_offset) touches; empty ranges vanish."""
    if stripe <= 0 or stripe & (stripe - 1):
        raise ValueError("stripe size must be a positive power of two")
    end = F.col("logical_off") + F.col("length")
    cut = ranges.where("length > 0").withColumn("stripe_id", F.explode(F.sequence(stripe_of(F.col("logical_off"), stripe), stripe_of(end - 1, stripe))))
    low = F.greatest("logical_off", F.col("stripe_id") * stripe)
    high = F.least(end, (F.col("stripe_id") + 1) * stripe)
    return cut.withColumns({"logical_off": low, "length": high - low, "segment_offset": F.col("segment_offset") + low - F.col("logical_off")})


_SWEPT = ["k1", "k2", "seq", "start", "end", "at", "tier", "segment_id"]


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _SWEPT sorted by k1, k2, start -> what is visible, with neighbouring pieces of a version joined up."""
    out: list[list] = [[] for _ in _SWEPT]
    key, at, active, last = None, 0, [], None

    def emit(v: tuple, start: int, end: int) -> None:
        nonlocal last
        if last and last[2] == v[2] and last[4] == start and last[:2] == key:
            last[4] = end
            return
        if last:
            for column, value in zip(out, last):
                column.append(value)
        last = [*key, v[2], start, end, *v[5:]]

    def advance(upto: int | None) -> None:
        """Everything before upto, where the next version starts; all that is left if there is none."""
        nonlocal at
        while active:
            v = active[0][1]
            if v[4] <= at:
                heapq.heappop(active)
                continue
            if upto is not None and at >= upto:
                return
            end = v[4] if upto is None else min(v[4], upto)
            emit(v, at, end)
            at = end

    def batch_of() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=_SWEPT)
        for c in out:
            c.clear()
        return found

    for batch in batches:
        for v in zip(*(c.to_pylist() for c in batch.columns)):
            if (k := [v[0], v[1]]) != key:
                advance(None)
                key = k
            else:
                advance(v[3])
            at = max(at, v[3]) if active else v[3]
            heapq.heappush(active, (-v[2], v))
        if len(out[0]) >= 1 << 15:
            yield batch_of()
    advance(None)
    if last:
        for column, value in zip(out, last):
            column.append(value)
    yield batch_of()


def _visible(ranges: DataFrame) -> DataFrame:
    """The sweep of ranges (_SWEPT, in any order)."""
    rows = together(ranges.select(*(F.col(c).cast("long").alias(c) for c in _SWEPT)), ["k1", "k2"], "start")
    return by_batch(rows, _sweep, ", ".join(f"{c} long" for c in _SWEPT))


def canonical_view(fragments: DataFrame) -> DataFrame:
    """What is visible of each (inode, stripe): disjoint pieces without holes, each with the seq of its version."""
    end = F.col("logical_off") + F.col("length")
    # at is where byte 0 of the file would lie in its segment
    rows = fragments.where("length > 0").select(F.col("inode").alias("k1"), F.col("stripe_id").alias("k2"), "seq", F.col("logical_off").alias("start"), end.alias("end"), (F.col("segment_offset") - F.col("logical_off")).alias("at"), "tier", "segment_id")
    kinds = {f.name: f.dataType for f in fragments.schema}
    piece = {"inode": F.col("k1"), "stripe_id": F.col("k2"), "seq": F.col("seq"), "logical_off": F.col("start"), "length": F.col("end") - F.col("start"), "tier": F.col("tier"), "segment_id": F.col("segment_id"), "segment_offset": F.col("at") + F.col("start")}
    return _visible(rows).select(*(v.cast(kinds[k]).alias(k) for k, v in piece.items()))


def fragments_in_range(fragments: DataFrame, reads: DataFrame, stripe: int = STRIPE_BYTES) -> DataFrame:
    """Whole fragments of the stripes that each read touches, not clipped; nothing for empty reads."""
    last = stripe_of(F.col("off") + F.col("r_length") - 1, stripe)
    r = reads.select("read_id", F.col("inode").alias("r_inode"), "off", F.col("length").alias("r_length")).where("r_length > 0")
    on = (F.col("inode") == F.col("r_inode")) & F.col("stripe_id").between(stripe_of(F.col("off"), stripe), last)
    return fragments.join(r, on).select("read_id", *fragments.columns)


def read_plan(fragments: DataFrame, reads: DataFrame, stripe: int = STRIPE_BYTES) -> DataFrame:
    """For each read (read_id, inode, off, length): slices in offset order that cover it exactly, holes marked sparse.

    Reads meet fragments stripe by stripe, so the join has the stripe among its keys, whether the fragments come split
    (with a stripe_id) or not.
    """
    r = reads.where("length > 0").select("read_id", F.col("inode").alias("r_inode"), F.col("off").alias("lo"), (F.col("off") + F.col("length")).alias("hi"))
    r = r.withColumn("r_stripe", F.explode(F.sequence(stripe_of(F.col("lo"), stripe), stripe_of(F.col("hi") - 1, stripe))))
    r = r.withColumns({"lo": F.greatest("lo", F.col("r_stripe") * stripe), "hi": F.least("hi", (F.col("r_stripe") + 1) * stripe)})
    f = fragments.where("length > 0") if "stripe_id" in fragments.columns else split_stripes(fragments, stripe)
    end = F.col("logical_off") + F.col("length")
    on = (F.col("inode") == F.col("r_inode")) & (F.col("stripe_id") == F.col("r_stripe")) & overlaps(F.col("logical_off"), end, F.col("lo"), F.col("hi"))
    key = [F.col("read_id").alias("k1"), F.col("r_stripe").alias("k2")]
    found = f.join(r, on).select(*key, "seq", F.greatest("logical_off", "lo").alias("start"), F.least(end, "hi").alias("end"), (F.col("segment_offset") - F.col("logical_off")).alias("at"), F.col("tier").cast("long").alias("tier"), F.col("segment_id").cast("long").alias("segment_id"))
    # Under all versions lies a hole as long as the read.
    none = F.lit(None).cast("long")
    holes = r.select(*key, F.lit(_HOLE).alias("seq"), F.col("lo").alias("start"), F.col("hi").alias("end"), none.alias("at"), none.alias("tier"), none.alias("segment_id"))
    pieces = _joined(_visible(found.unionByName(holes)), stripe)
    sparse = F.col("seq") == _HOLE
    return pieces.select(F.col("k1").alias("read_id"), F.col("start").alias("logical_off"), (F.col("end") - F.col("start")).alias("length"), sparse.alias("sparse"), F.col("tier").cast(fragments.schema["tier"].dataType).alias("tier"), "segment_id", (F.col("at") + F.col("start")).alias("segment_offset"))


_HOLE = -1 << 62


def _joined(pieces: DataFrame, stripe: int) -> DataFrame:
    """Pieces of one version that meet at a border of stripes as one: the window sees at most two pieces a stripe."""
    border = (F.col("start") % stripe == 0) | (F.col("end") % stripe == 0)
    order = Window.partitionBy("k1").orderBy("start")
    same = (F.col("seq") == F.lag("seq").over(order)) & (F.col("start") == F.lag("end").over(order)) & F.col("at").eqNullSafe(F.lag("at").over(order))
    marked = pieces.where(border).withColumn("begins", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("begins").over(order))
    least = [F.min(c).alias(c) for c in ("seq", "start")] + [F.max("end").alias("end")] + [F.min(c).alias(c) for c in ("at", "tier", "segment_id")]
    return pieces.where(~border).drop("k2").unionByName(marked.groupBy("k1", "island").agg(*least).drop("island"))


def merged_read(stored: DataFrame, pending: DataFrame, reads: DataFrame, sizes: DataFrame | None = None, stripe: int = STRIPE_BYTES) -> DataFrame:
    """read_plan over stored and unflushed fragments; with sizes (inode, size), reads end at the size.

    Both inputs should come from one snapshot; a fragment seen in both has one seq and the same bytes.
    """
    if sizes is not None:
        known = sizes.select(F.col("inode").alias("s_inode"), "size")
        reads = reads.join(known, F.col("inode") == F.col("s_inode")).select("read_id", "inode", "off", clamp(F.col("off"), F.col("length"), F.col("size")).alias("length"))
    return read_plan(stored.unionByName(pending), reads, stripe)


def clamp(off: Column, length: Column, size: Column) -> Column:
    """Bytes that a read gets: none at or behind the end, else up to it."""
    return F.when(off >= size, F.lit(0)).otherwise(F.least(off + length, size) - off).cast("long")


def read_slices(plan: DataFrame, chunks: DataFrame, size: int = SLICE_BYTES) -> DataFrame:
    """read_id, offset and data: the plan's bytes in slices of at most size, zeros in holes; nothing gathers a read.

    chunks (tier, segment_id, chunk, data) are a segment's bytes in pieces of size, numbered from 0. A slice of the plan is cut
    where it crosses a chunk, so each row needs one chunk, and the join is by segment and chunk.
    """
    first, last = F.expr(f"segment_offset div {size}"), F.expr(f"(segment_offset + length - 1) div {size}")
    stored = plan.where("NOT sparse").withColumn("chunk", F.explode(F.sequence(first, last)))
    low, high = F.greatest("segment_offset", F.col("chunk") * size), F.least(F.col("segment_offset") + F.col("length"), (F.col("chunk") + 1) * size)
    stored = stored.select("read_id", (F.col("logical_off") + low - F.col("segment_offset")).alias("offset"), (low - F.col("chunk") * size + 1).cast("int").alias("from"), (high - low).cast("int").alias("n"), "tier", "segment_id", "chunk")
    c = chunks.select("tier", "segment_id", F.col("chunk").cast("long").alias("chunk"), F.col("data").alias("content"))
    joined = stored.join(c, ["tier", "segment_id", "chunk"], "left")
    spot = F.concat(F.lit("missing segment "), F.col("segment_id").cast("string"), F.lit(", chunk "), F.col("chunk").cast("string"))
    missing = F.raise_error(spot).cast("binary")
    data = F.when(F.col("content").isNull(), missing).otherwise(F.expr("substring(content, from, n)"))
    holes = plan.where("sparse").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {size}"))))
    zeros = F.expr(f"CAST(repeat('\\0', CAST(least({size}, length - k * {size}) AS INT)) AS BINARY)")
    return joined.select("read_id", "offset", data.alias("data")).union(holes.select("read_id", (F.col("logical_off") + F.col("k") * size).alias("offset"), zeros.alias("data")))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices in the order of reads and offsets -> the MD5 of each read's bytes as upper-case hex; one slice is held at a time."""
    read, digest = None, None
    for batch in batches:
        out = []
        for r, data in zip(batch.column(0).to_pylist(), batch.column(2)):
            if r != read:
                if digest:
                    out.append((read, digest.hexdigest()))
                read, digest = r, hashlib.md5()
            digest.update(data.as_py().hex().upper().encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], names=["read_id", "digest"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([read], pa.int64()), pa.array([digest.hexdigest()])], names=["read_id", "digest"])


def read_digests(slices: DataFrame) -> DataFrame:
    """read_id and digest of each read's bytes, from read_slices()."""
    return by_batch(together(slices, ["read_id"], "offset"), _digested, "read_id long, digest string")


def stripe_fragments(fragments: DataFrame, inode: int, stripe_id: int) -> DataFrame:
    """The fragments of one stripe, in the order of their keys."""
    return fragments.where((F.col("inode") == inode) & (F.col("stripe_id") == stripe_id)).sort("seq")
