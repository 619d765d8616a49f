"""Binary layouts of keys, nodes and fragments, for importing and exporting raw records.

Keys are big-endian, so that byte order is numeric order; values are little-endian. Expressions encode and decode in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.schemas import FRAGMENT_BYTES, NODE_FIXED_BYTES

# The tag that starts each kind of key.
NODE_TAG, DIRENT_TAG, STRIPE_TAG = b"n", b"d", b"s"
#: The key of the next inode.
NEXT_INODE_KEY = b"Mni"


def big_endian(n: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def little_endian(n: Column, width: int) -> Column:
    text = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(text, 2 * k + 1, 2) for k in reversed(range(width)))))


def from_big_endian(b: Column, at: int, width: int) -> Column:
    return F.conv(F.hex(F.substring(b, at + 1, width)), 16, 10).try_cast("long")


def from_little_endian(b: Column, at: int, width: int) -> Column:
    text = F.concat(*(F.hex(F.substring(b, at + k + 1, 1)) for k in reversed(range(width))))
    return F.conv(text, 16, 10).try_cast("long")


def node_key(inode: Column) -> Column:
    return F.concat(F.lit(bytearray(NODE_TAG)), big_endian(inode, 8))


def dirent_key(parent: Column, name: Column) -> Column:
    return F.concat(F.lit(bytearray(DIRENT_TAG)), big_endian(parent, 8), name.cast("binary"))


def fragment_key(inode: Column, stripe_id: Column, seq: Column) -> Column:
    return F.concat(F.lit(bytearray(STRIPE_TAG)), big_endian(inode, 8), big_endian(stripe_id, 4), big_endian(seq, 8))


def key_kind(key: Column) -> Column:
    """What a stripe key's length says: 21 bytes a fragment, 13 a legacy list; null for others."""
    stripe = F.substring(key, 1, 1) == F.lit(bytearray(STRIPE_TAG))
    return F.when(stripe & (F.length(key) == 21), "fragment").when(stripe & (F.length(key) == 13), "legacy")


def fragment_value(tier: Column, segment_id: Column, segment_offset: Column, length: Column, logical_off: Column, seq: Column) -> Column:
    """40 bytes: seq, offset, length (8 each), tier (1, 3 of padding), segment (4), segment offset (8)."""
    return F.concat(little_endian(seq, 8), little_endian(logical_off, 8), little_endian(length, 8), little_endian(tier, 1), F.lit(bytearray(3)), little_endian(segment_id, 4), little_endian(segment_offset, 8))


def decode_fragments(rows: DataFrame) -> DataFrame:
    """key and value of legacy lists -> a fragment row for each whole 40 bytes; bytes left over don't count."""
    n = F.floor(F.length("value") / FRAGMENT_BYTES).cast("int")
    each = rows.withColumn("n", n).where("n > 0").select("key", "value", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    one = each.select("key", F.expr(f"substring(value, k * {FRAGMENT_BYTES} + 1, {FRAGMENT_BYTES})").alias("v"))
    v, key = F.col("v"), F.col("key")
    return one.select(
        from_big_endian(key, 1, 8).alias("inode"), from_big_endian(key, 9, 4).alias("stripe_id"), from_little_endian(v, 0, 8).alias("seq"), from_little_endian(v, 8, 8).alias("logical_off"),
        from_little_endian(v, 16, 8).alias("length"), from_little_endian(v, 24, 1).cast("tinyint").alias("tier"), from_little_endian(v, 28, 4).alias("segment_id"), from_little_endian(v, 32, 8).alias("segment_offset"),
    )


def node_value(n: str = "") -> Column:
    """58 fixed bytes and the symlink target, from the columns of a nodes table (prefix n with an alias and a dot)."""
    c = lambda name: F.col(n + name)
    target = F.coalesce(c("symlink_target"), F.lit("")).cast("binary")
    fixed = [("inode", 8), ("mode", 4), ("nlink", 4), ("uid", 4), ("gid", 4), ("size", 8), ("mtime_ns", 8), ("ctime_ns", 8), ("atime_ns", 8)]
    return F.concat(*(little_endian(c(k), w) for k, w in fixed), little_endian(F.length(target), 2), target)


def decode_nodes(rows: DataFrame) -> DataFrame:
    """value -> nodes; a value that is too short, or shorter than its target says, is an error."""
    v, target = F.col("value"), from_little_endian(F.col("value"), NODE_FIXED_BYTES - 2, 2)
    short = (F.length(v) < NODE_FIXED_BYTES) | (target > F.length(v) - NODE_FIXED_BYTES)
    checked = rows.withColumn("value", F.when(short, F.raise_error(F.lit("node record too short")).cast("binary")).otherwise(v))
    at = 0
    out = []
    for name, width, kind in (("inode", 8, "long"), ("mode", 4, "int"), ("nlink", 4, "long"), ("uid", 4, "long"), ("gid", 4, "long"), ("size", 8, "long"), ("mtime_ns", 8, "long"), ("ctime_ns", 8, "long"), ("atime_ns", 8, "long")):
        out.append(from_little_endian(v, at, width).cast(kind).alias(name))
        at += width
    link = F.expr(f"CAST(substring(value, {NODE_FIXED_BYTES + 1}, length(value)) AS STRING)")
    return checked.select(*out, F.when(target > 0, F.substring(link, F.lit(1), target.cast("int"))).alias("symlink_target"))
