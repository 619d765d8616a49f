import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import overlay as O
from tidemark.schemas import FRAGMENTS

READS = "read_id long, inode long, off long, length long"


def fragments(spark, rows):
    """(seq, off, len, tier, segment, segment_offset) of inode 1, stripe 0."""
    return spark.createDataFrame([(1, 0, s, o, n, t, g, p) for s, o, n, t, g, p in rows], FRAGMENTS)


def plan(spark, rows, off, length):
    found = O.read_plan(fragments(spark, rows), spark.createDataFrame([(7, 1, off, length)], READS)).sort("logical_off").collect()
    return [(r.logical_off, r.length, None if r.sparse else (r.segment_id, r.segment_offset)) for r in found]


def test_disjoint_with_gap(spark):
    assert plan(spark, [(1, 0, 10, 1, 1, 100), (2, 30, 10, 1, 1, 200)], 5, 30) == [(5, 5, (1, 105)), (10, 20, None), (30, 5, (1, 200))]


def test_shadowing(spark):
    assert plan(spark, [(1, 0, 20, 1, 1, 100), (2, 5, 10, 1, 1, 500)], 0, 20) == [(0, 5, (1, 100)), (5, 10, (1, 500)), (15, 5, (1, 115))]


def test_all_sparse_and_empty(spark):
    assert plan(spark, [], 0, 100) == [(0, 100, None)]
    assert plan(spark, [(1, 0, 20, 1, 1, 100)], 5, 0) == []


def test_canonical_keeps_seq_and_tier(spark):
    rows = O.canonical_view(fragments(spark, [(1, 0, 20, 1, 7, 100), (2, 5, 10, 2, 9, 500), (3, 40, 0, 1, 1, 0)])).sort("logical_off").collect()
    assert [(r.seq, r.logical_off, r.length, r.tier, r.segment_id, r.segment_offset) for r in rows] == [(1, 0, 5, 1, 7, 100), (2, 5, 10, 2, 9, 500), (1, 15, 5, 1, 7, 115)]


def test_random_against_bytes(spark):
    """Byte by byte: the newest version that covers it."""
    rng, rows, reads = random.Random(5), [], []
    for inode in range(40):
        rows += [(inode, 0, seq, off := rng.randrange(80), rng.randrange(1, 40), 1, seq, 1000 * seq + off) for seq in range(1, rng.randrange(2, 12))]
        reads.append((inode, inode, rng.randrange(60), rng.randrange(1, 60)))
    f = spark.createDataFrame(rows, FRAGMENTS)
    top = {}
    for inode, _, seq, off, n, *_ in rows:
        for b in range(off, off + n):
            top[inode, b] = max(top.get((inode, b), 0), seq)
    seen = {}
    for r in O.canonical_view(f).collect():
        for b in range(r.logical_off, r.logical_off + r.length):
            assert (r.inode, b) not in seen
            seen[r.inode, b] = r.seq
            assert r.segment_offset + b - r.logical_off == 1000 * r.seq + b
    assert seen == top
    for r in O.read_plan(f, spark.createDataFrame(reads, READS)).collect():
        for b in range(r.logical_off, r.logical_off + r.length):
            assert (top.get((r.read_id, b)) or None) == (None if r.sparse else r.segment_id)
    total = O.read_plan(f, spark.createDataFrame(reads, READS)).groupBy("read_id").agg(F.sum("length")).collect()
    assert dict(map(tuple, total)) == {i: n for i, _, _, n in reads}


def test_split_needs_power_of_two(spark):
    with pytest.raises(ValueError):
        O.split_stripes(fragments(spark, []), 1000)
    pieces = O.split_stripes(fragments(spark, [(1, 1 << 19, 3 << 20, 1, 1, 0)]).drop("stripe_id"), 1 << 20).collect()
    assert len(pieces) == 4 and sum(p.length for p in pieces) == 3 << 20


def test_payloads_with_holes_and_missing_segment(spark):
    f = fragments(spark, [(1, 2, 3, 1, 1, 4)])
    reads = spark.createDataFrame([(1, 1, 0, 7)], READS)
    chunks = spark.createDataFrame([(1, 1, 0, bytearray(b"....a")), (1, 1, 1, bytearray(b"bc..."))], "tier tinyint, segment_id long, chunk long, data binary")
    slices = O.read_slices(O.read_plan(f, reads), chunks, 5)
    assert b"".join(bytes(r.data) for r in slices.sort("offset").collect()) == b"\0\0abc\0\0"
    assert O.read_digests(slices).first().digest == hashlib.md5(b"00006162630000").hexdigest()
    with pytest.raises(Exception, match="missing segment"):
        O.read_slices(O.read_plan(f, reads), chunks.limit(0), 5).collect()


def test_hot_stripe_with_many_versions(spark):
    """A hundred thousand versions of one stripe, half of which are still seen."""
    n = 100_000
    k = F.col("id")
    rows = spark.range(n).select(F.lit(1).cast("long").alias("inode"), F.lit(0).cast("long").alias("stripe_id"), (k + 1).alias("seq"), (k * 7919 % (n // 2) * 10).alias("logical_off"), F.lit(10).cast("long").alias("length"), F.lit(1).cast("tinyint").alias("tier"), k.alias("segment_id"), (k * 7919 % (n // 2) * 10).alias("segment_offset"))
    got = O.canonical_view(rows).agg(F.count(F.lit(1)), F.sum("length"), F.min("seq")).first()
    assert tuple(got) == (n // 2, n // 2 * 10, n // 2 + 1)


def test_long_read_is_joined_at_borders(spark):
    """Holes and a version over several stripes are one slice each; the join has the stripe among its keys."""
    v = spark.createDataFrame([(1, 5, 100, 60, 1, 3, 0)], "seq long, inode long, logical_off long, length long, tier tinyint, segment_id long, segment_offset long")
    plan = O.read_plan(v, spark.createDataFrame([(9, 5, 3, 400)], READS), 16)
    assert [(r.logical_off, r.length, r.sparse, r.segment_offset) for r in plan.sort("logical_off").collect()] == [(3, 97, True, None), (100, 60, False, 0), (160, 243, True, None)]
    assert "r_stripe" in plan._jdf.queryExecution().optimizedPlan().toString()
