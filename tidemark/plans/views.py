"""The engine's tables derived from the supplied star schema, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.overlay import split_stripes

STRIPE = 16384
#: Sizes for the read plans: one read of each inode.
READ_OFF, READ_LENGTH = 5000, 40000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(events: DataFrame) -> DataFrame:
    """An unsplit fragment for each event: a write of its user's file."""
    return events.select(
        F.col("user_id").alias("inode"), (F.col("event_id") + 1).alias("seq"), (F.col("event_id") * 7919 % 65536).alias("logical_off"), (1 + F.col("event_id") * 104729 % 4096).alias("length"),
        F.when(F.col("event_type").isin("click", "view"), 1).otherwise(2).cast("tinyint").alias("tier"), F.expr("event_id div 1000").alias("segment_id"), (F.col("event_id") % 1000 * 4140 + 40).alias("segment_offset"),
    )


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = split_stripes(versions(table(spark, sf_dir, "events")), STRIPE)
    return out.select("inode", "stripe_id", "seq", "logical_off", "length", "tier", "segment_id", "segment_offset")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read of each inode."""
    inodes = table(spark, sf_dir, "events").select(F.col("user_id").alias("inode")).distinct()
    return inodes.select(F.col("inode").alias("read_id"), "inode", F.lit(READ_OFF).cast("long").alias("off"), F.lit(READ_LENGTH).cast("long").alias("length"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments that fragments refer to, three more a tier that none does, the last of a tier being active."""
    used = fragments(spark, sf_dir).select("tier", "segment_id").distinct()
    last = used.groupBy("tier").agg(F.max("segment_id").alias("m"))
    more = last.select("tier", F.explode(F.sequence(F.col("m") + 1, F.col("m") + 3)).alias("segment_id"))
    both = used.union(more)
    active = both.groupBy("tier").agg(F.max("segment_id").alias("active"))
    return both.join(active, "tier").select("tier", "segment_id", (1000 + F.col("segment_id") * 10).alias("size"), (F.col("segment_id") == F.col("active")).alias("is_active"))


def dirents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root 1 > regions 2 + k > nations 100 + k > customers 1000 + k."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    long = lambda x: x.cast("long")
    return (
        r.select(F.lit(1).cast("long").alias("parent"), F.col("r_name").alias("name"), long(2 + F.col("r_regionkey")).alias("child"))
        .unionByName(n.select(long(2 + F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"), long(100 + F.col("n_nationkey")).alias("child")))
        .unionByName(c.select(long(100 + F.col("c_nationkey")).alias("parent"), F.col("c_name").alias("name"), (1000 + F.col("c_custkey")).alias("child")))
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories for the root, regions and nations, with the stored nlink 2; a file for each customer."""
    root = spark.range(1).select(F.lit(1).cast("long").alias("inode"))
    r, n = table(spark, sf_dir, "region").select((2 + F.col("r_regionkey")).cast("long").alias("inode")), table(spark, sf_dir, "nation").select((100 + F.col("n_nationkey")).cast("long").alias("inode"))
    dirs = root.union(r).union(n).select("inode", F.lit(0o040755).alias("mode"), F.lit(2).cast("long").alias("nlink"), F.lit(0).cast("long").alias("size"))
    files = table(spark, sf_dir, "customer").select((1000 + F.col("c_custkey")).alias("inode"), F.lit(0o100644).alias("mode"), F.lit(1).cast("long").alias("nlink"), (F.col("c_custkey") * 37 % 9973).alias("size"))
    both = dirs.unionByName(files)
    ns = F.col("inode") * 1_000_000_007
    return both.select("inode", "mode", "nlink", (F.col("inode") % 5).alias("uid"), (F.col("inode") % 3).alias("gid"), "size", ns.alias("mtime_ns"), (ns + 1).alias("ctime_ns"), (ns + 2).alias("atime_ns"), F.lit(None).cast("string").alias("symlink_target"))


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("op"), F.round(F.col("value") * 100).cast("long").alias("duration_nanos"), (F.col("event_type") == "error").alias("is_error"), "event_id")


#: The same tables for DuckDB, as the body of a WITH clause.
SQL = """
versions AS (
  SELECT user_id AS inode, event_id + 1 AS seq, event_id * 7919 % 65536 AS logical_off, 1 + event_id * 104729 % 4096 AS length,
         CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 2 END AS tier, event_id // 1000 AS segment_id, event_id % 1000 * 4140 + 40 AS segment_offset
  FROM events),
fragments AS (
  SELECT inode, stripe_id, seq, greatest(logical_off, stripe_id * 16384) AS logical_off,
         least(logical_off + length, (stripe_id + 1) * 16384) - greatest(logical_off, stripe_id * 16384) AS length,
         tier, segment_id, segment_offset + greatest(logical_off, stripe_id * 16384) - logical_off AS segment_offset
  FROM (SELECT *, unnest(range(logical_off // 16384, (logical_off + length - 1) // 16384 + 1)) AS stripe_id FROM versions)),
reads AS (SELECT DISTINCT user_id AS read_id, user_id AS inode, 5000 AS lo, 45000 AS hi FROM events),
used AS (SELECT DISTINCT tier, segment_id FROM fragments),
both_segments AS (
  SELECT tier, segment_id FROM used
  UNION ALL SELECT tier, unnest(range(m + 1, m + 4)) FROM (SELECT tier, max(segment_id) AS m FROM used GROUP BY tier)),
segments AS (
  SELECT tier, segment_id, 1000 + segment_id * 10 AS size, segment_id = max(segment_id) OVER (PARTITION BY tier) AS is_active FROM both_segments),
dirents AS (
  SELECT 1::BIGINT AS parent, r_name AS name, (2 + r_regionkey)::BIGINT AS child FROM region
  UNION ALL SELECT 2 + n_regionkey, n_name, 100 + n_nationkey FROM nation
  UNION ALL SELECT 100 + c_nationkey, c_name, 1000 + c_custkey FROM customer),
base_nodes AS (
  SELECT 1::BIGINT AS inode, 16877 AS mode, 2 AS nlink, 0 AS size
  UNION ALL SELECT 2 + r_regionkey, 16877, 2, 0 FROM region
  UNION ALL SELECT 100 + n_nationkey, 16877, 2, 0 FROM nation
  UNION ALL SELECT 1000 + c_custkey, 33188, 1, c_custkey * 37 % 9973 FROM customer),
nodes AS (
  SELECT inode, mode, nlink, inode % 5 AS uid, inode % 3 AS gid, size, inode * 1000000007 AS mtime_ns, inode * 1000000007 + 1 AS ctime_ns, inode * 1000000007 + 2 AS atime_ns
  FROM base_nodes),
op_log AS (SELECT event_type AS op, round(value * 100)::BIGINT AS duration_nanos, event_type = 'error' AS is_error, event_id FROM events)
"""
#: What is visible of each (inode, stripe), by another route than the library's: every byte boundary, newest cover, runs.
CANONICAL = """
points AS (SELECT inode, stripe_id, logical_off AS s FROM fragments UNION SELECT inode, stripe_id, logical_off + length FROM fragments),
ranges AS (SELECT inode, stripe_id, s, lead(s) OVER (PARTITION BY inode, stripe_id ORDER BY s) AS e FROM points),
covered AS (
  SELECT r.inode, r.stripe_id, r.s, r.e, max(f.seq) AS seq FROM ranges r
  JOIN fragments f ON f.inode = r.inode AND f.stripe_id = r.stripe_id AND f.logical_off <= r.s AND f.logical_off + f.length >= r.e
  WHERE r.e IS NOT NULL GROUP BY ALL),
flagged AS (
  SELECT *, CASE WHEN seq = lag(seq) OVER w AND s = lag(e) OVER w THEN 0 ELSE 1 END AS b FROM covered WINDOW w AS (PARTITION BY inode, stripe_id ORDER BY s)),
runs AS (SELECT *, sum(b) OVER (PARTITION BY inode, stripe_id ORDER BY s) AS g FROM flagged),
merged AS (SELECT inode, stripe_id, seq, min(s) AS logical_off, max(e) - min(s) AS length FROM runs GROUP BY inode, stripe_id, seq, g),
canonical AS (
  SELECT m.inode, m.stripe_id, m.seq, m.logical_off, m.length, f.tier, f.segment_id, f.segment_offset + m.logical_off - f.logical_off AS segment_offset
  FROM merged m JOIN fragments f ON f.inode = m.inode AND f.stripe_id = m.stripe_id AND f.seq = m.seq)
"""
