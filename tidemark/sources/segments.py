"""Segment files: framing, packing into files, discovery, scanning with torn-tail cut-off, removal, and legacy imports.

Records are framed in the JVM. A file's bytes travel as chunks (segment_id, chunk, data) of SLICE_BYTES, so a segment of any
size is never one value. A scan walks a file's chunks in order and yields its records up to the first that is short or fails
a check, which is what a repair keeps.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.codecs import DIRENT_TAG, NEXT_INODE_KEY, NODE_TAG, STRIPE_TAG, little_endian
from tidemark.functions.scalars import framed_size, segment_file, segment_id_of
from tidemark.plans.groups import by_batch, together
from tidemark.plans.ordered import running_total
from tidemark.schemas import HEADER_BYTES, RECORD_MAGIC, RECORD_VERSION, RECORDS, SEGMENT_BYTES, SLICE_BYTES, TRAILER_BYTES

_HEADER = struct.Struct("<4sBBHQIQqI")


def frame(records: DataFrame) -> DataFrame:
    """records (inode, stripe_id, seq, logical_off, payload, ...) with `framed`: header, payload and checksum."""
    body = F.concat(
        F.lit(bytearray([RECORD_VERSION, 0, 0, 0])), little_endian(F.col("inode"), 8), little_endian(F.col("stripe_id"), 4), little_endian(F.col("seq"), 8),
        little_endian(F.col("logical_off"), 8), little_endian(F.length("payload"), 4), F.col("payload"),
    )
    return records.withColumn("__body", body).withColumn("framed", F.concat(F.lit(bytearray(RECORD_MAGIC)), "__body", little_endian(F.crc32("__body"), 4))).drop("__body")


def rotate(records: DataFrame, max_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """seq, tier, length -> segment_id and segment_offset as a single appender would assign them.

    A record goes to the active file if it still fits, else to a new one; one that fits nowhere gets a file of its own. That is
    a fold over each tier in seq order: one task a tier, over three numbers a record. pack() has no such limit.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        ids, offsets, current, used = [], [], 1, 0
        for n in rows["length"]:
            size = HEADER_BYTES + int(n) + TRAILER_BYTES
            if used and used + size > max_bytes:
                current, used = current + 1, 0
            ids.append(current)
            offsets.append(used + HEADER_BYTES)
            used += size
        return pd.DataFrame({"tier": rows["tier"], "seq": rows["seq"], "segment_id": ids, "segment_offset": offsets})

    return records.select("tier", "seq", "length").groupBy("tier").applyInPandas(fold, "tier tinyint, seq long, segment_id long, segment_offset long")


def pack(records: DataFrame, max_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """As rotate(), but files are cut where the running size passes a multiple of max_bytes: distributed, and full to a record."""
    rows = running_total(records.select("tier", "seq", "length"), ["tier", "seq"], framed_size(F.col("length")), "before")
    first = rows.groupBy("tier").agg(F.min("before").alias("base"))
    placed = rows.join(F.broadcast(first), "tier")  # a row for each of the two tiers
    at = F.col("before") - F.col("base")
    placed = placed.withColumn("segment_id", F.floor(at / max_bytes).cast("long") + 1)
    start = placed.groupBy("tier", "segment_id").agg(F.min("before").alias("start"))
    return placed.join(start, ["tier", "segment_id"]).select("tier", "seq", "segment_id", (F.col("before") - F.col("start") + HEADER_BYTES).alias("segment_offset"))


def _cut(rows: DataFrame, keys: list[str], start, data: str, size: int) -> DataFrame:
    """rows' data, which begins at the offset start, cut at multiples of size: keys, chunk, at (in the chunk), data."""
    end = start + F.length(data)
    cut = rows.withColumn("__start", start).withColumn("__end", end).where(F.length(data) > 0)
    cut = cut.withColumn("chunk", F.explode(F.expr(f"sequence(__start div {size}, (__end - 1) div {size})")))
    low, high = F.greatest("__start", F.col("chunk") * size), F.least("__end", (F.col("chunk") + 1) * size)
    return cut.select(*keys, "chunk", (low - F.col("chunk") * size).alias("at"), F.col(data).substr((low - F.col("__start") + 1).cast("int"), (high - low).cast("int")).alias("data"))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of tier, segment, chunk and spot -> chunks."""
    names, key, held = ["tier", "segment_id", "chunk", "data"], None, []

    def chunk() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int8()), *(pa.array([k], pa.int64()) for k in key[1:]), pa.array([b"".join(held)], pa.binary())], names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != key:
                if held:
                    yield chunk()
                key, held = row[:3], []
            held.append(row[4])
    if held:
        yield chunk()


def chunks(framed: DataFrame, size: int = SLICE_BYTES) -> DataFrame:
    """tier, segment_id, chunk and data: the files that framed records (segment_offset is that of the payload) make."""
    start = (F.col("segment_offset") - HEADER_BYTES).cast("long")
    pieces = _cut(framed.select(F.col("tier").cast("tinyint").alias("tier"), F.col("segment_id").cast("long").alias("segment_id"), "segment_offset", "framed"), ["tier", "segment_id"], start, "framed", size)
    key = ["tier", "segment_id", "chunk"]
    return by_batch(together(pieces, key, "at"), _filled, "tier tinyint, segment_id long, chunk long, data binary")


def write_files(chunks: DataFrame, folder: str) -> None:
    """`%010d.seg` files for chunks (segment_id, chunk, data), in a folder that all executors mount; a file is written by
    one task, chunk by chunk, and gets its name when it is whole."""

    def save(rows: Iterator) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        name, out = None, None
        for r in rows:
            if r["file"] != name:
                if out:
                    done(out, name)
                name, out = r["file"], Path(folder, f".{r['file']}.{uuid.uuid4().hex}").open("wb")
            out.write(r["data"])
        if out:
            done(out, name)

    def done(out, name: str) -> None:
        out.close()
        Path(out.name).rename(Path(folder, name))

    files = chunks.select(segment_file(F.col("segment_id")).alias("file"), "chunk", "data")
    together(files, ["file"], "chunk").foreachPartition(save)


def remove_files(spark: SparkSession, folder: str, segments: DataFrame) -> int:
    """Delete the files of segments (segment_id) in a folder, and how many there were; ids without a file don't matter."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = segments.select(segment_file(F.col("segment_id")).alias("file")).distinct().toLocalIterator()
    return sum(store.delete(spark._jvm.org.apache.hadoop.fs.Path(root, r["file"]), False) for r in names)


def stray_files(spark: SparkSession, folder: str, segments: DataFrame) -> DataFrame:
    """segment_id of the files in a folder that segments (segment_id) doesn't list and that aren't the active one."""
    return discover(spark, folder).where("NOT is_active").join(segments.select(F.col("segment_id").cast("long")).distinct(), "segment_id", "left_anti").select("segment_id")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """segment_id, size, is_active of the segment files in a folder; names that aren't a 32-bit number don't count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.seg").load(folder).select("path", "length")
    found = files.select(segment_id_of(F.col("path")).alias("segment_id"), F.col("length").alias("size")).where("segment_id IS NOT NULL")
    last = found.agg(F.max("segment_id").alias("last"))  # one row
    return found.crossJoin(F.broadcast(last)).select("segment_id", "size", (F.col("segment_id") == F.col("last")).alias("is_active"))


def load(spark: SparkSession, folder: str, size: int = SLICE_BYTES) -> DataFrame:
    """segment_id, chunk and data of the segment files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.seg").load(folder)
    rows = files.select(segment_id_of(F.col("path")).alias("segment_id"), "content").where("segment_id IS NOT NULL")
    return _cut(rows, ["segment_id"], F.lit(0).cast("long"), "content", size).drop("at")


class Parser:
    """The good records of one file, whose bytes come in any pieces."""

    def __init__(self) -> None:
        self.held, self.at, self.bad = b"", 0, False

    def feed(self, data: bytes) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
        """(inode, stripe, seq, offset, length, payload offset, payload) of each record that is whole now, in order."""
        self.held = self.held + data if self.held else data
        begin = 0
        while not self.bad and begin + HEADER_BYTES <= len(self.held):
            magic, version, _, _, inode, stripe, seq, off, length = _HEADER.unpack_from(self.held, begin)
            if magic != RECORD_MAGIC or version != RECORD_VERSION:
                self.bad = True
                break
            end = begin + HEADER_BYTES + length
            if end + TRAILER_BYTES > len(self.held):
                break
            if zlib.crc32(self.held[begin + 4 : end]) != int.from_bytes(self.held[end : end + TRAILER_BYTES], "little"):
                self.bad = True
                break
            yield inode, stripe, seq, off, length, self.at + begin + HEADER_BYTES, self.held[begin + HEADER_BYTES : end]
            begin = end + TRAILER_BYTES
        self.at += begin
        self.held = b"" if self.bad else self.held[begin:]


def parse(content: bytes) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    return Parser().feed(content)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of segment and chunk -> records. A file whose chunks have a gap ends there."""
    kinds = [pa.int64()] * 7 + [pa.binary()]
    names = ["segment_id", "inode", "stripe_id", "seq", "logical_off", "length", "payload_off", "payload"]
    segment, parser, due, rows = None, Parser(), 0, []
    for batch in batches:
        for of, chunk, data in zip(*(c for c in batch.columns)):
            if of.as_py() != segment:
                segment, parser, due = of.as_py(), Parser(), 0
            parser.bad |= chunk.as_py() != due
            due += 1
            for row in parser.feed(data.as_py() or b"") if not parser.bad else ():
                rows.append((segment, *row))
                if len(rows) == 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def scan(chunks: DataFrame) -> DataFrame:
    """segment_id, chunk, data -> one row for each good record of the prefix of a file before the first bad one."""
    rows = chunks.select(F.col("segment_id").cast("long").alias("segment_id"), F.col("chunk").cast("long").alias("chunk"), "data")
    return by_batch(together(rows, ["segment_id"], "chunk"), _scanned, RECORDS)


def good_sizes(chunks: DataFrame) -> DataFrame:
    """segment_id, size and good_size, the offset at which a torn tail would be cut."""
    ends = scan(chunks).groupBy("segment_id").agg(F.max(F.col("payload_off") + F.col("length") + TRAILER_BYTES).alias("good_size"))
    sizes = chunks.groupBy(F.col("segment_id").cast("long").alias("segment_id")).agg(F.sum(F.length("data")).cast("long").alias("size"))
    return sizes.join(ends, "segment_id", "left").select("segment_id", "size", F.coalesce("good_size", F.lit(0)).alias("good_size"))


def repaired(chunks: DataFrame, size: int = SLICE_BYTES) -> DataFrame:
    """The chunks without torn tails: the last is cut, those behind it go, a file without a good record has none."""
    sizes = good_sizes(chunks).select("segment_id", "good_size")
    left = F.col("good_size") - F.col("chunk") * size
    kept = chunks.withColumn("segment_id", F.col("segment_id").cast("long")).join(sizes, "segment_id").where(left > 0)
    return kept.withColumn("data", F.col("data").substr(F.lit(1), F.least(left, F.lit(size)).cast("int"))).select(*chunks.columns)


def get(keys: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """keys with their records of table (its other columns) and `found`; null where there is none."""
    return keys.join(table.withColumn("__found", F.lit(True)), on, "left").withColumn("found", F.coalesce("__found", F.lit(False))).drop("__found")


def legacy_keys(rows: DataFrame) -> DataFrame:
    """Legacy rows (bucket, key, value) as key and value of one key space: each bucket's keys get its tag, and of the meta
    bucket the next inode is taken over. A key of a wrong length is an error; other buckets don't matter."""
    n, bucket = F.length("key"), F.col("bucket")
    good = F.when(bucket == "nodes", n == 8).when(bucket == "dirents", n >= 8).when(bucket == "stripes", n == 12).otherwise(True)
    checked = F.when(~good, F.raise_error(F.concat(bucket, F.lit(" key of length "), n.cast("string"))).cast("binary")).otherwise(F.col("key"))
    tags = {"nodes": NODE_TAG, "dirents": DIRENT_TAG, "stripes": STRIPE_TAG}
    key = F.when((bucket == "_l4_meta") & (F.col("key") == F.lit(bytearray(b"next_inode"))), F.lit(bytearray(NEXT_INODE_KEY)))
    for name, tag in tags.items():
        key = key.when(bucket == name, F.concat(F.lit(bytearray(tag)), checked))
    return rows.select(key.alias("key"), "value").where("key IS NOT NULL")


def import_table(spark: SparkSession, source: str, target: str, columns: list[str] | None = None) -> bool:
    """Copy a legacy table to a new path once: its columns, or, without any, its buckets (bucket, key, value) by legacy_keys.

    Nothing to do without a source, an error if the target exists. The source is renamed to `.migrated` when all is written.
    """
    try:
        rows = spark.read.parquet(source)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    (rows.select(*columns) if columns else legacy_keys(rows)).write.mode("errorifexists").parquet(target)
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, spark._jvm.org.apache.hadoop.fs.Path(source + ".migrated")):
        raise RuntimeError(f"{source} was imported but can't be renamed")
    return True
