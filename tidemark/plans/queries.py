"""The operators as queries over the derived tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import codecs, scalars as S
from tidemark.operators import maintenance as M, namespace as N, overlay as O, telemetry as T, writes as W
from tidemark.plans import views as V
from tidemark.schemas import TIER_COLD
from tidemark.session import scratch
from tidemark.sources import segments as G
from tidemark.streaming import flush as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: bool = True, canonical: bool = False):
    """Register a query under its name, with its SQL after the derived views."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
            body = sql.replace("RECURSIVE", "").strip()
            head = V.SQL.strip() + (",\n" + V.CANONICAL.strip() if canonical else "")
            if views:
                body = f"WITH {recursive}{head}{',' if body.startswith(',') else ''}\n{body.lstrip(',')}"
            ORACLE[f.__name__] = body
        return f

    return register


# --- overlay ---------------------------------------------------------------------------------------------------------


@query("SELECT * FROM canonical", canonical=True)
def canonical_view(spark, d):
    return O.canonical_view(V.fragments(spark, d))


ORACLE_HOT = V.CANONICAL.replace("fragments", "hot").strip()


@query(", hot AS (SELECT 1 AS inode, 0 AS stripe_id, seq, logical_off, length, tier, segment_id, segment_offset FROM versions),\n" + ORACLE_HOT + " SELECT * FROM canonical")
def canonical_sweep(spark, d):
    """Every event a version of one stripe of one file."""
    hot = V.versions(V.table(spark, d, "events")).withColumns({"inode": F.lit(1).cast("long"), "stripe_id": F.lit(0).cast("long")})
    return O.canonical_view(hot)


_PLAN = """, clipped AS (
  SELECT read_id, seq, greatest(logical_off, lo) AS a, least(logical_off + length, hi) AS b, tier, segment_id, segment_offset - logical_off AS base
  FROM {source} f JOIN reads r ON f.inode = r.inode AND logical_off < hi AND logical_off + length > lo),
p AS (SELECT read_id, a AS s FROM clipped UNION SELECT read_id, b FROM clipped UNION SELECT read_id, lo FROM reads UNION SELECT read_id, hi FROM reads),
q AS (SELECT read_id, s, lead(s) OVER (PARTITION BY read_id ORDER BY s) AS e FROM p),
c AS (SELECT q.read_id, s, e, max(seq) AS seq FROM q LEFT JOIN clipped x ON x.read_id = q.read_id AND a <= s AND b >= e WHERE e IS NOT NULL GROUP BY ALL),
g AS (SELECT *, CASE WHEN coalesce(seq, -1) = lag(coalesce(seq, -1)) OVER w THEN 0 ELSE 1 END AS brk FROM c WINDOW w AS (PARTITION BY read_id ORDER BY s)),
h AS (SELECT *, sum(brk) OVER (PARTITION BY read_id ORDER BY s) AS i FROM g),
m AS (SELECT read_id, i, seq, min(s) AS s, max(e) AS e FROM h GROUP BY ALL),
x AS (SELECT DISTINCT read_id, seq, tier, segment_id, base FROM clipped)
SELECT m.read_id, s AS logical_off, e - s AS length, m.seq IS NULL AS sparse, tier, segment_id, base + s AS segment_offset
FROM m LEFT JOIN x ON x.read_id = m.read_id AND x.seq = m.seq"""


@query(_PLAN.format(source="versions"))
def read_plan(spark, d):
    return O.read_plan(V.versions(V.table(spark, d, "events")), V.reads(spark, d), V.STRIPE)


@query(_PLAN.format(source="versions"))
def merged_read(spark, d):
    v = V.versions(V.table(spark, d, "events"))
    return O.merged_read(v.where("seq % 3 <> 0"), v.where("seq % 3 = 0"), V.reads(spark, d), stripe=V.STRIPE)


@query(_PLAN.format(source="versions").replace("reads r ON", "reads r ON", 1).replace(", clipped AS (", ", sized AS (SELECT inode, max(logical_off + length) // 2 AS size FROM versions GROUP BY inode),\nbounded_reads AS (SELECT read_id, r.inode, lo, least(hi, size) AS hi FROM reads r JOIN sized USING (inode) WHERE lo < size), clipped AS (", 1).replace("JOIN reads r", "JOIN bounded_reads r").replace("FROM reads", "FROM bounded_reads").replace("FROM bounded_reads r JOIN sized", "FROM reads r JOIN sized"))
def sized_read(spark, d):
    """Reads of stored and pending fragments that end at the size, half of what was ever written."""
    v = V.versions(V.table(spark, d, "events"))
    sizes = v.groupBy("inode").agg(F.expr("max(logical_off + length) div 2").alias("size"))
    return O.merged_read(v.where("seq % 3 <> 0"), v.where("seq % 3 = 0"), V.reads(spark, d), sizes, V.STRIPE)


@query("SELECT read_id, least(lo + 40000, size) - lo AS n FROM (SELECT read_id, lo, (inode % 7) * 9000 AS size FROM reads) WHERE lo < size UNION ALL SELECT read_id, 0 FROM reads WHERE lo >= (inode % 7) * 9000")
def read_clamp(spark, d):
    r = V.reads(spark, d).withColumn("size", F.col("inode") % 7 * 9000)
    return r.select("read_id", O.clamp(F.col("off"), F.col("length"), F.col("size")).alias("n"))


@query("SELECT inode, stripe_id, seq, logical_off, length, tier, segment_id, segment_offset FROM fragments")
def stripe_split(spark, d):
    return V.fragments(spark, d)


@query("SELECT read_id, f.inode, stripe_id, seq, logical_off, length, tier, segment_id, segment_offset FROM fragments f JOIN reads r ON f.inode = r.inode AND stripe_id BETWEEN lo // 16384 AND (hi - 1) // 16384")
def fragments_in_range(spark, d):
    return O.fragments_in_range(V.fragments(spark, d), V.reads(spark, d), V.STRIPE)


@query("SELECT DISTINCT inode, stripe_id FROM fragments")
def stripes_of(spark, d):
    return V.fragments(spark, d).select("inode", "stripe_id").distinct().sort("inode", "stripe_id")


@query("SELECT seq, logical_off < 30000 AND logical_off + length > 20000 AS overlaps, logical_off // 16384 AS stripe_id FROM versions")
def overlap_test(spark, d):
    v, end = V.versions(V.table(spark, d, "events")), F.col("logical_off") + F.col("length")
    return v.select("seq", O.overlaps(F.col("logical_off"), end, F.lit(20000), F.lit(30000)).alias("overlaps"), O.stripe_of(F.col("logical_off"), V.STRIPE).alias("stripe_id"))


@query(
    """, lists AS (SELECT inode, stripe_id, list((seq, logical_off, length, tier, segment_id, segment_offset) ORDER BY seq) AS a, list((seq, logical_off, length, tier, segment_id, segment_offset) ORDER BY logical_off, seq) AS b FROM fragments GROUP BY ALL)
SELECT inode, stripe_id, a = b AS same FROM lists"""
)
def fragment_lists_equal(spark, d):
    """Whether a stripe's whole records in the order of seqs are those in the order of offsets."""
    record = F.struct("seq", "logical_off", "length", "tier", "segment_id", "segment_offset")
    lists = V.fragments(spark, d).groupBy("inode", "stripe_id").agg(F.sort_array(F.collect_list(record)).alias("a"), F.transform(F.sort_array(F.collect_list(F.struct("logical_off", "seq", record.alias("r")))), lambda x: x["r"]).alias("b"))
    return lists.select("inode", "stripe_id", (F.col("a") == F.col("b")).alias("same"))


@query("SELECT seq, lpad(to_hex(inode), 16, '0') = lpad(to_hex(logical_off % 100), 16, '0') AS same FROM versions")
def bytes_equal(spark, d):
    """Equality of byte slices, of any lengths and values."""
    v = V.versions(V.table(spark, d, "events"))
    a, b = codecs.big_endian(F.col("inode"), 8), codecs.big_endian(F.col("logical_off") % 100, 8)
    return v.select("seq", S.same_bytes(a, b).alias("same"))


@query("SELECT o.o_orderkey + o.o_orderkey % 2 AS key, c.o_custkey AS value, c.o_orderkey IS NOT NULL AS found FROM orders o LEFT JOIN orders c ON c.o_orderkey = o.o_orderkey + o.o_orderkey % 2", views=False)
def point_get(spark, d):
    """Records by key, with whether they exist."""
    orders = V.table(spark, d, "orders")
    keys = orders.select((F.col("o_orderkey") + F.col("o_orderkey") % 2).alias("key"))
    return G.get(keys, orders.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("value")), ["key"])


@query("SELECT f.inode, f.stripe_id, f.seq, f.logical_off, f.length FROM fragments f WHERE f.inode = 7 AND f.stripe_id = 1")
def one_stripe(spark, d):
    return O.stripe_fragments(V.fragments(spark, d), 7, 1).select("inode", "stripe_id", "seq", "logical_off", "length")


# --- maintenance -----------------------------------------------------------------------------------------------------


_ROLLUP = """, raw AS (SELECT inode, stripe_id, sum(CASE WHEN tier = 1 THEN length ELSE 0 END)::BIGINT AS hot_bytes, sum(CASE WHEN tier = 2 THEN length ELSE 0 END)::BIGINT AS cold_bytes FROM fragments GROUP BY ALL),
live AS (SELECT inode, stripe_id, sum(length)::BIGINT AS live_bytes FROM canonical GROUP BY ALL)
"""


@query(_ROLLUP + "SELECT * FROM raw JOIN live USING (inode, stripe_id)", canonical=True)
def stripe_rollup(spark, d):
    return M.stripe_rollup(V.fragments(spark, d))


_USED, _MAX = 1_000_000, 900_000


@query(
    """, raw AS (SELECT inode, stripe_id, sum(CASE WHEN tier = 1 THEN length ELSE 0 END)::BIGINT AS hot_bytes FROM fragments GROUP BY ALL),
hot AS (SELECT *, coalesce(sum(hot_bytes) OVER (ORDER BY inode, stripe_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM raw WHERE hot_bytes > 0)
SELECT inode, stripe_id, hot_bytes FROM hot WHERE before < 2 * (1000000 - 720000) OR before = 0"""
)
def evict_candidates(spark, d):
    return M.evict_candidates(M.stripe_rollup(V.fragments(spark, d)), _USED, _MAX)


_COMPACT = """, picked AS (SELECT * FROM canonical WHERE inode % 4 = 1 AND stripe_id = 1)
SELECT inode, stripe_id, seq, logical_off, length, tier, segment_id, segment_offset, false AS moved FROM fragments WHERE NOT (inode % 4 = 1 AND stripe_id = 1)
UNION ALL SELECT inode, stripe_id, 10000000 + row_number() OVER (PARTITION BY inode, stripe_id ORDER BY logical_off) - 1, logical_off, length, 2, segment_id, segment_offset, tier <> 2 FROM picked"""


@query(_COMPACT, canonical=True)
def compact_stripe(spark, d):
    f = V.fragments(spark, d)
    return M.compact(f, f.where("inode % 4 = 1 AND stripe_id = 1"), TIER_COLD, 10_000_000)


@query("SELECT s.* FROM segments s WHERE NOT is_active AND NOT EXISTS (SELECT 1 FROM fragments f WHERE f.tier = s.tier AND f.segment_id = s.segment_id)")
def gc_segments(spark, d):
    return M.gc_segments(V.segments(spark, d), V.fragments(spark, d))


@query("SELECT tier, count(*) AS segments, sum(size)::BIGINT AS bytes, max(segment_id) FILTER (is_active) AS active_id FROM segments GROUP BY tier")
def segment_usage(spark, d):
    return M.segment_usage(V.segments(spark, d))


@query("SELECT inode, stripe_id, seq, logical_off, CASE WHEN inode % 2 = 0 THEN least(length, 20000 - logical_off) ELSE length END AS length, tier, segment_id, segment_offset FROM fragments WHERE inode % 2 <> 0 OR logical_off < 20000")
def truncate_fragments(spark, d):
    f = V.fragments(spark, d)
    return M.truncate(f, f.where("inode % 2 = 0").select("inode").distinct().withColumn("size", F.lit(20000)))


@query("SELECT inode, stripe_id, seq, logical_off, length, tier, segment_id, segment_offset FROM fragments WHERE inode % 10 <> 3")
def delete_inodes(spark, d):
    f = V.fragments(spark, d)
    return M.delete_inodes(f, f.where("inode % 10 = 3").select("inode")).select(*f.columns)


@query(
    "SELECT * FROM (VALUES (0, 1), (1, 2), (2, 4), (3, 8), (4, 16), (5, 30), (20, 30)) t(errors, seconds)",
    views=False,
)
def backoff(spark, d):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 20)], "errors int")
    return rows.select("errors", M.backoff(F.lit(1), F.lit(30), F.col("errors")).alias("seconds"))


@query(
    """, runs AS (SELECT event_id AS tick_s, event_id % 10 < 4 AS failed, event_id % 3 AS evicts, event_id % 2 AS gcs, event_id % 7 AS moves_failed, duration_nanos AS n FROM op_log),
last AS (SELECT max(tick_s) FILTER (NOT failed) AS clean FROM runs)
SELECT sum(evicts)::BIGINT AS evicts, sum(gcs)::BIGINT AS gcs, sum(evicts)::BIGINT AS moves_ok, sum(moves_failed)::BIGINT AS moves_failed, sum(n)::BIGINT AS bytes_moved, sum(n)::BIGINT AS move_nanos, sum(n * 2)::BIGINT AS gc_nanos,
       max(tick_s) AS last_tick_s, max(tick_s) FILTER (failed) AS last_error_s, (SELECT count(*) FROM runs r, last WHERE r.tick_s > clean) AS consecutive_errors,
       sum(n)::DOUBLE / sum(evicts) AS move_avg_nanos, sum(n * 2)::DOUBLE / sum(gcs) AS gc_avg_nanos FROM runs"""
)
def mover_summary(spark, d):
    log, n, at = V.op_log(spark, d), F.col("duration_nanos"), F.col("event_id")
    evicts = (at % 3).alias("evicts")
    return M.mover_summary(log.select(at.alias("tick_s"), (at % 10 < 4).alias("failed"), evicts, (at % 2).alias("gcs"), evicts.alias("moves_ok"), (at % 7).alias("moves_failed"), n.alias("bytes_moved"), n.alias("move_nanos"), (n * 2).alias("gc_nanos")))


@query(
    """SELECT user_id AS mover, event_id AS tick, n AS consecutive_errors, CASE WHEN n = 0 THEN 30 WHEN n >= 4 THEN 300 ELSE 30 * 2 ** n END::BIGINT AS delay
FROM (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY user_id, streak ORDER BY event_id) AS n
      FROM (SELECT user_id, event_id, event_id % 5 < 3 AS failed, count(*) FILTER (event_id % 5 >= 3) OVER (PARTITION BY user_id ORDER BY event_id) AS streak FROM events))""",
    views=False,
)
def mover_schedule(spark, d):
    """Each user's events as the passes of a mover: how long it waits after each."""
    at = F.col("event_id")
    return M.schedule(V.table(spark, d, "events").select(F.col("user_id").alias("mover"), at.alias("tick"), (at % 5 < 3).alias("failed")), 30, 300)


@query("SELECT max(seq) + 1 AS next_seq FROM fragments")
def next_seq(spark, d):
    """Seqs go on behind the highest there is, as the data has it."""
    return spark.createDataFrame([(M.next_seq(V.fragments(spark, d)),)], "next_seq long")


@query("SELECT 4096 AS block_size, 10000000 // 4096 AS blocks, (10000000 - used) // 4096 AS blocks_free, (10000000 - used) // 4096 AS blocks_avail FROM (SELECT sum(size)::BIGINT AS used FROM segments WHERE tier = 1)")
def statfs(spark, d):
    return M.statfs(V.segments(spark, d), 10_000_000)


# --- namespace -------------------------------------------------------------------------------------------------------


_TREE = """RECURSIVE, tree AS (
  SELECT child AS inode, '/' || name AS path, 1 AS depth FROM dirents WHERE parent = 1
  UNION ALL SELECT d.child, t.path || '/' || d.name, t.depth + 1 FROM tree t JOIN dirents d ON d.parent = t.inode)
"""


@query(_TREE + "SELECT inode, path, depth FROM tree")
def path_tree(spark, d):
    return N.path_tree(V.dirents(spark, d))


@query(
    _TREE
    + """SELECT path, inode, 0 AS status FROM tree WHERE depth <= 2
UNION ALL SELECT path || '/none', NULL, 2 FROM tree WHERE depth <= 2
UNION ALL SELECT path || '/x', NULL, 20 FROM tree WHERE depth = 3"""
)
def path_lookup(spark, d):
    tree = N.path_tree(V.dirents(spark, d)).select("path", "depth")
    paths = tree.where("depth <= 2").select("path").union(tree.where("depth <= 2").select(F.concat("path", F.lit("/none")))).union(tree.where("depth = 3").select(F.concat("path", F.lit("/x"))))
    return N.walk_paths(paths.withColumn("parts", S.split_path(F.col("path"))), V.dirents(spark, d), V.nodes(spark, d))


@query("SELECT parent, name, 0 AS status, child FROM dirents UNION ALL SELECT parent, name || '?', 2, NULL FROM dirents UNION ALL SELECT parent, name || '/', 22, NULL FROM dirents")
def lookup(spark, d):
    e = V.dirents(spark, d).select("parent", "name")
    asked = e.union(e.select("parent", F.concat("name", F.lit("?")))).union(e.select("parent", F.concat("name", F.lit("/"))))
    return N.lookup(asked, V.dirents(spark, d), V.nodes(spark, d))


@query("SELECT d.parent, d.name, n.inode, n.mode, n.size FROM dirents d JOIN nodes n ON n.inode = d.child")
def readdir(spark, d):
    return N.readdir(V.dirents(spark, d), V.nodes(spark, d))


@query("SELECT child AS inode, min(parent) AS parent FROM dirents GROUP BY child")
def find_parent(spark, d):
    return N.find_parent(V.dirents(spark, d))


@query(
    """RECURSIVE, up AS (SELECT child AS inode, parent AS ancestor, 1 AS steps FROM dirents
  UNION ALL SELECT u.inode, d.parent, u.steps + 1 FROM up u JOIN dirents d ON d.child = u.ancestor)
SELECT inode, ancestor, steps FROM up"""
)
def ancestors(spark, d):
    e = V.dirents(spark, d)
    return N.ancestors(e.select(F.col("child").alias("inode")), e)


@query("SELECT child AS candidate, 2 + n_regionkey AS root, true AS below FROM dirents JOIN nation ON parent = 100 + n_nationkey UNION ALL SELECT child, 7 + child, false FROM dirents UNION ALL SELECT child, child, true FROM dirents")
def descendant_test(spark, d):
    e = V.dirents(spark, d)
    region = V.table(spark, d, "nation").select((100 + F.col("n_nationkey")).cast("long").alias("parent"), (2 + F.col("n_regionkey")).cast("long").alias("root"))
    pairs = e.join(region, "parent").select(F.col("child").alias("candidate"), "root").union(e.select("child", F.col("child") + 7)).union(e.select("child", "child"))
    return N.is_descendant(pairs, e)


@query("SELECT inode FROM nodes WHERE mode = 16877 AND inode NOT IN (SELECT parent FROM dirents WHERE child < 1000 OR parent % 3 = 0)")
def empty_dirs(spark, d):
    """Two thirds of the nations have lost their customers."""
    return N.empty_dirs(V.dirents(spark, d).where("child < 1000 OR parent % 3 = 0"), V.nodes(spark, d))


@query(
    """SELECT inode, CASE WHEN mode = 16877 THEN 2 + (SELECT count(*) FROM dirents d JOIN nodes c ON c.inode = d.child WHERE d.parent = n.inode AND c.mode = 16877)
  ELSE (SELECT count(*) FROM dirents d WHERE d.child = n.inode) END AS nlink FROM nodes n"""
)
def link_count(spark, d):
    return N.link_counts(V.dirents(spark, d), V.nodes(spark, d))


@query(
    """, live AS (SELECT 1000 + user_id AS inode, max(event_id * 7919 % 65536 + 1) AS s, max(event_id * 1000000000) AS m FROM events GROUP BY user_id)
SELECT n.inode, greatest(size, coalesce(s, size)) AS size, greatest(mtime_ns, coalesce(m, mtime_ns)) AS mtime_ns, CASE WHEN m > mtime_ns THEN greatest(ctime_ns, m) ELSE ctime_ns END AS ctime_ns
FROM nodes n LEFT JOIN live USING (inode)"""
)
def stat_overlay(spark, d):
    pending = V.table(spark, d, "events").select((1000 + F.col("user_id")).alias("inode"), (F.col("event_id") * 7919 % 65536).alias("logical_off"), F.lit(1).alias("length"), (F.col("event_id") * 1_000_000_000).alias("mtime_ns"), F.col("event_id").alias("seq"))
    return N.stat(V.nodes(spark, d), L.live_attributes(pending)).select("inode", "size", "mtime_ns", "ctime_ns")


@query(
    """SELECT inode, mode, size, uid, gid, mtime_ns // 1000000000 AS mtime, mtime_ns % 1000000000 AS mtime_nsec, ctime_ns // 1000000000 AS ctime, ctime_ns % 1000000000 AS ctime_nsec,
  atime_ns // 1000000000 AS atime, atime_ns % 1000000000 AS atime_nsec, CASE WHEN mode = 16877 THEN 2 ELSE 1 END AS nlink, 4096 AS blksize, (size + 511) // 512 AS blocks, mode & 61440 AS stable_mode, 1 AS generation FROM nodes"""
)
def attr_projection(spark, d):
    return N.attributes(V.nodes(spark, d))


@query(
    """SELECT inode, CASE WHEN inode % 3 = 0 THEN (mode & ~4095) | 3968 ELSE mode END AS mode, uid, CASE WHEN inode % 3 = 0 THEN 77 ELSE gid END AS gid, CASE WHEN inode % 6 = 0 THEN 5 ELSE size END AS size,
  mtime_ns, CASE WHEN inode % 3 = 0 THEN 99 ELSE ctime_ns END AS ctime_ns FROM nodes"""
)
def setattr_apply(spark, d):
    n = V.nodes(spark, d)
    none = F.lit(None).cast("long")
    u = n.where("inode % 3 = 0").select("inode", F.lit(0o177600).alias("mode"), none.alias("uid"), F.lit(77).alias("gid"), F.when(F.col("inode") % 2 == 0, 5).alias("size"), none.alias("mtime_ns"), none.alias("atime_ns"))
    return N.setattr_(n, u, F.lit(99).cast("long")).select("inode", "mode", "uid", "gid", "size", "mtime_ns", "ctime_ns")


def _asked(spark, d):
    """For each customer a request: a name that is taken, a parent that is a file, a bad name, or one that applies (a file, a
    directory or a symbolic link)."""
    k, id_ = F.col("child") % 4, F.col("child")
    return V.dirents(spark, d).where("child >= 1000").select(
        id_.alias("request_id"), F.when(id_ % 16 == 3, "dir").when(id_ % 16 == 7, "symlink").otherwise("file").alias("kind"), F.when(k == 1, id_).otherwise(F.col("parent")).alias("parent"),
        F.when(k == 0, F.col("name")).when(k == 2, "a/b").otherwise(F.concat("name", F.lit(".new"))).alias("name"), F.lit(0o644).alias("mode"), F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("gid"), F.concat(F.lit("../"), "name").alias("target"),
    )


_MADE = """, asked AS (SELECT child AS id, parent, name FROM dirents WHERE child >= 1000),
made AS (SELECT id, parent, name || '.new' AS name, '../' || name AS target, 1000000 + row_number() OVER (ORDER BY id) - 1 AS inode FROM asked WHERE id % 4 = 3)
"""


@query(_MADE + "SELECT id AS request_id, CASE WHEN id % 4 = 0 THEN 17 WHEN id % 4 = 1 THEN 20 WHEN id % 4 = 2 THEN 22 ELSE 0 END AS status, inode FROM asked LEFT JOIN made USING (id)")
def create_nodes(spark, d):
    return N.create(_asked(spark, d), V.dirents(spark, d), V.nodes(spark, d), 1_000_000, 5)[0]


@query(
    _MADE
    + """, dirs AS (SELECT parent AS inode, count(*) AS n FROM made WHERE id % 16 = 3 GROUP BY parent)
SELECT inode, mode, nlink + coalesce(n, 0) AS nlink, size, CASE WHEN n > 0 THEN 5 ELSE ctime_ns END AS ctime_ns, NULL AS symlink_target, NULL AS name FROM nodes LEFT JOIN dirs USING (inode)
UNION ALL SELECT inode, CASE WHEN id % 16 = 3 THEN 16804 WHEN id % 16 = 7 THEN 41471 ELSE 33188 END, CASE WHEN id % 16 = 3 THEN 2 ELSE 1 END, CASE WHEN id % 16 = 7 THEN strlen(target) ELSE 0 END, 5, CASE WHEN id % 16 = 7 THEN target END, name FROM made"""
)
def created_nodes(spark, d):
    """All nodes after create, mkdir and symlink, the new ones with their names."""
    e = V.dirents(spark, d)
    _, entries, nodes = N.create(_asked(spark, d), e, V.nodes(spark, d), 1_000_000, 5)
    names = entries.where("child >= 1000000").select(F.col("child").alias("inode"), "name")
    return nodes.join(names, "inode", "left").select("inode", "mode", "nlink", "size", "ctime_ns", "symlink_target", "name")


@query(_MADE + "SELECT inode, CASE WHEN id % 16 = 7 THEN 0 ELSE 22 END AS status, CASE WHEN id % 16 = 7 THEN target END AS target FROM made UNION ALL SELECT -inode, 2, NULL FROM nodes")
def readlink(spark, d):
    """The targets of new links; EINVAL for other new nodes, ENOENT for inodes that there aren't."""
    nodes = N.create(_asked(spark, d), V.dirents(spark, d), V.nodes(spark, d), 1_000_000, 5)[2]
    asked = nodes.where("inode >= 1000000").select("inode").union(V.nodes(spark, d).select(-F.col("inode")))
    return N.readlink(asked, nodes)


@query("SELECT inode, 0 AS status FROM nodes UNION ALL SELECT -inode, 2 FROM nodes")
def open_status(spark, d):
    n = V.nodes(spark, d)
    return N.open_inodes(n.select("inode").union(n.select(-F.col("inode"))), n)


def _unlinked(spark, d):
    """Unlinks of every fifth entry, of names that don't exist or aren't names, of directories, and of entries to nowhere; half
    of the customers have a second name."""
    e = V.dirents(spark, d)
    more = e.where("child >= 1000 AND child % 2 = 0").select("parent", F.concat("name", F.lit(".2")).alias("name"), "child").union(e.where("child < 100").select("parent", F.concat("name", F.lit(".gone")).alias("name"), -F.col("child")))
    n = V.nodes(spark, d).withColumn("nlink", F.when((F.col("inode") >= 1000) & (F.col("inode") % 2 == 0), 2).otherwise(F.col("nlink")).cast("long"))
    whole = e.unionByName(more)
    asked = e.where("child % 5 = 0").select(F.col("child").alias("request_id"), "parent", "name").union(e.where("child % 5 = 1").select("child", "parent", F.when(F.col("child") % 2 == 0, "..").otherwise("none")))
    asked = asked.union(whole.where("child < 0").select("child", "parent", "name")).union(e.where("child >= 1000 AND child % 10 = 0").select(F.col("child") + 1_000_000, "parent", F.concat("name", F.lit(".2"))))
    return N.unlink(asked, whole, n, 5)


@query(
    """SELECT child AS request_id, CASE WHEN child < 1000 THEN 21 ELSE 0 END AS status FROM dirents WHERE child % 5 = 0
UNION ALL SELECT child, CASE WHEN child % 2 = 0 THEN 22 ELSE 2 END FROM dirents WHERE child % 5 = 1
UNION ALL SELECT -child, 5 FROM dirents WHERE child < 100 UNION ALL SELECT child + 1000000, 0 FROM dirents WHERE child >= 1000 AND child % 10 = 0"""
)
def unlink_status(spark, d):
    return _unlinked(spark, d)[0]


@query(
    """SELECT parent, name, child FROM dirents WHERE child < 1000 OR child % 5 <> 0 UNION ALL SELECT parent, name || '.2', child FROM dirents WHERE child >= 1000 AND child % 2 = 0 AND child % 10 <> 0
UNION ALL SELECT parent, name || '.gone', -child FROM dirents WHERE child < 100"""
)
def unlink_files(spark, d):
    return _unlinked(spark, d)[1].select("parent", "name", "child")


@query(
    """SELECT inode, CASE WHEN inode >= 1000 AND inode % 2 = 0 THEN 2 ELSE nlink END AS nlink, ctime_ns, false AS freed FROM nodes WHERE inode < 1000 OR inode % 5 <> 0
UNION ALL SELECT inode, NULL, NULL, true FROM nodes WHERE inode >= 1000 AND inode % 5 = 0"""
)
def unlink_nodes(spark, d):
    """Nodes after the unlinks, and those whose last name went."""
    _, _, nodes, gone = _unlinked(spark, d)
    none = F.lit(None).cast("long")
    return nodes.select("inode", "nlink", "ctime_ns", F.lit(False).alias("freed")).union(gone.select("inode", none, none, F.lit(True)))


def _removed(spark, d):
    """Every entry is asked to go, names that aren't names too; a third of the nations are empty."""
    e = V.dirents(spark, d).where("child < 1000 OR parent % 3 > 0")
    asked = e.select(F.col("child").alias("request_id"), "parent", "name").union(e.where("child < 1000").select(-F.col("child"), "parent", F.lit(".")))
    return N.rmdir(asked, e, V.nodes(spark, d), 5)


_LEFT = ", kept AS (SELECT * FROM dirents WHERE child < 1000 OR parent % 3 > 0), empty AS (SELECT * FROM kept WHERE child < 1000 AND child NOT IN (SELECT parent FROM kept))\n"


@query(_LEFT + "SELECT child AS request_id, CASE WHEN child >= 1000 THEN 20 WHEN child IN (SELECT child FROM empty) THEN 0 ELSE 39 END AS status FROM kept UNION ALL SELECT -child, 22 FROM kept WHERE child < 1000")
def rmdir_status(spark, d):
    return _removed(spark, d)[0]


@query(_LEFT + "SELECT inode, nlink - coalesce(m, 0) AS nlink, CASE WHEN m > 0 THEN 5 ELSE ctime_ns END AS ctime_ns FROM nodes LEFT JOIN (SELECT parent AS inode, count(*) AS m FROM empty GROUP BY parent) USING (inode) WHERE inode NOT IN (SELECT child FROM empty)")
def rmdir_nodes(spark, d):
    return _removed(spark, d)[2].select("inode", "nlink", "ctime_ns")


def _linked(spark, d):
    """A second name for every file; one for a directory, under a file, with a name that is taken or none."""
    e, id_ = V.dirents(spark, d), F.col("child")
    kind = id_ % 4
    return N.link(e.select(id_.alias("request_id"), id_.alias("inode"), F.when(kind == 1, id_).otherwise(F.col("parent")).alias("parent"), F.when(kind == 2, F.col("name")).when(kind == 3, "").otherwise(F.concat("name", F.lit(".ln"))).alias("name")), e, V.nodes(spark, d), 5)


@query("SELECT child AS request_id, CASE WHEN child % 4 = 3 THEN 22 WHEN child < 1000 THEN 1 WHEN child % 4 = 1 THEN 20 WHEN child % 4 = 2 THEN 17 ELSE 0 END AS status FROM dirents")
def link_status(spark, d):
    return _linked(spark, d)[0]


@query("SELECT inode, nlink + done AS nlink, CASE WHEN done = 1 THEN 5 ELSE ctime_ns END AS ctime_ns FROM (SELECT *, CASE WHEN inode >= 1000 AND inode % 4 = 0 THEN 1 ELSE 0 END AS done FROM nodes)")
def link_nodes(spark, d):
    return _linked(spark, d)[2].select("inode", "nlink", "ctime_ns")


def _renamed(spark, d):
    """Even customers move to the first region; of the odd ones every third replaces a file of another parent, every
    third asks what is refused, and the rest ask twice for one source. Regions and nations can't go below themselves, and a
    nation moves to another region."""
    e = V.dirents(spark, d)
    move = lambda rows, parent, name, id_=F.col("child"): rows.select(id_.alias("request_id"), F.col("parent").alias("old_parent"), F.col("name").alias("old_name"), parent.cast("long").alias("new_parent"), name.alias("new_name"))
    child, first = F.col("child"), F.lit(2)
    odd = e.where("child >= 1000 AND child % 2 = 1")
    taken = e.where("child >= 1000 AND child % 6 = 1").select((child + 2).alias("other"), F.col("parent").alias("old_parent"), F.col("name").alias("old_name"), child.alias("request_id"))
    targets = e.select(child.alias("other"), F.col("parent").alias("new_parent"), F.col("name").alias("new_name"))
    over = taken.join(targets, "other").select("request_id", "old_parent", "old_name", "new_parent", "new_name")
    bad = move(odd.where("child % 6 = 5 AND child % 4 = 1"), first, F.lit("a/b")).union(move(odd.where("child % 6 = 5 AND child % 4 = 3"), child, F.lit("x")))
    twice = move(odd.where("child % 6 = 5"), first, F.concat("name", F.lit(".again")), child + 2_000_000).union(move(odd.where("child % 6 = 5"), F.lit(3), F.concat("name", F.lit(".twice")), child + 3_000_000))
    loops = move(e.where("child < 1000"), child, F.lit("loop"), child + 4_000_000)
    dirs = move(e.where("child BETWEEN 100 AND 999 AND child % 5 = 0"), 2 + (F.col("parent") - 1) % 5, F.concat("name", F.lit(".moved")))
    files = move(e.where("child >= 1000 AND child % 2 = 0"), first, F.concat("name", F.lit(".moved")))
    return N.rename(files.union(over).union(bad).union(twice).union(loops).union(dirs), e, V.nodes(spark, d), 5)


_OVER = ", hit AS (SELECT a.child AS id, a.parent AS old_parent, b.parent AS parent, b.name, b.child AS victim FROM dirents a JOIN dirents b ON b.child = a.child + 2 WHERE a.child >= 1000 AND a.child % 6 = 1)\n"


@query(
    _OVER
    + """SELECT child AS request_id, 0 AS status FROM dirents WHERE child >= 1000 AND child % 2 = 0 UNION ALL SELECT id, 0 FROM hit
UNION ALL SELECT child, CASE WHEN child % 4 = 1 THEN 22 ELSE 20 END FROM dirents WHERE child >= 1000 AND child % 6 = 5
UNION ALL SELECT child + 2000000, 0 FROM dirents WHERE child >= 1000 AND child % 6 = 5 UNION ALL SELECT child + 3000000, 2 FROM dirents WHERE child >= 1000 AND child % 6 = 5
UNION ALL SELECT child + 4000000, 22 FROM dirents WHERE child < 1000 UNION ALL SELECT child, 0 FROM dirents WHERE child BETWEEN 100 AND 999 AND child % 5 = 0"""
)
def rename_status(spark, d):
    return _renamed(spark, d)[0]


@query(
    _OVER
    + """SELECT parent, name, child FROM dirents WHERE child < 100 OR child < 1000 AND child % 5 <> 0 UNION ALL SELECT 2 + (parent - 1) % 5, name || '.moved', child FROM dirents WHERE child BETWEEN 100 AND 999 AND child % 5 = 0
UNION ALL SELECT 2, name || '.moved', child FROM dirents WHERE child >= 1000 AND child % 2 = 0 UNION ALL SELECT 2, name || '.again', child FROM dirents WHERE child >= 1000 AND child % 6 = 5
UNION ALL SELECT parent, name, id FROM hit UNION ALL SELECT parent, name, child FROM dirents WHERE child >= 1000 AND (child % 6 = 3 AND child NOT IN (SELECT victim FROM hit) OR child % 6 = 1 AND child NOT IN (SELECT id FROM hit))"""
)
def rename_apply(spark, d):
    return _renamed(spark, d)[1].select("parent", "name", "child")


@query(
    _OVER
    + """, gone AS (SELECT parent AS inode, -1 AS n FROM dirents WHERE child BETWEEN 100 AND 999 AND child % 5 = 0 UNION ALL SELECT 2 + (parent - 1) % 5, 1 FROM dirents WHERE child BETWEEN 100 AND 999 AND child % 5 = 0),
delta AS (SELECT inode, sum(n)::BIGINT AS n FROM gone GROUP BY inode)
SELECT inode, nlink + coalesce(n, 0) AS nlink, CASE WHEN n IS NOT NULL THEN 5 ELSE ctime_ns END AS ctime_ns, false AS freed FROM nodes LEFT JOIN delta USING (inode) WHERE inode NOT IN (SELECT victim FROM hit)
UNION ALL SELECT victim, NULL, NULL, true FROM hit"""
)
def rename_nodes(spark, d):
    """Nodes after the renames, and the overwritten ones whose last name went."""
    _, _, nodes, gone = _renamed(spark, d)
    none = F.lit(None).cast("long")
    return nodes.select("inode", "nlink", "ctime_ns", F.lit(False).alias("freed")).union(gone.select("inode", none, none, F.lit(True)))


# --- writes ----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, 2 + row_number() OVER (ORDER BY o_orderkey) - 1 AS inode FROM orders", views=False)
def inode_seq_assign(spark, d):
    return W.allocate(V.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 2)


@query(
    """, pieces AS (SELECT f.*, v.seq AS arrival FROM fragments f JOIN versions v ON v.seq = f.seq WHERE f.seq % 5 = 0)
SELECT inode, stripe_id, 10000000 + row_number() OVER (ORDER BY arrival, logical_off) - 1 AS seq, logical_off, length, 1 AS tier, segment_id, segment_offset FROM pieces
UNION ALL SELECT inode, stripe_id, seq, logical_off, length, tier, segment_id, segment_offset FROM fragments WHERE seq % 5 <> 0"""
)
def bulk_commit(spark, d):
    bulk = W.BulkSession(V.STRIPE)
    bulk.write(V.versions(V.table(spark, d, "events")).where("seq % 5 = 0").withColumnRenamed("seq", "arrival"))
    return bulk.commit(V.fragments(spark, d).where("seq % 5 <> 0"), 10_000_000)


@query("SELECT inode, seq, logical_off, length FROM versions WHERE logical_off // 16384 <> (logical_off + length - 1) // 16384")
def straddling_extents(spark, d):
    return W.straddling(V.versions(V.table(spark, d, "events")), V.STRIPE).select("inode", "seq", "logical_off", "length")


@query(
    """, ends AS (SELECT 1000 + inode AS inode, max(logical_off + length) AS e FROM fragments GROUP BY ALL)
SELECT n.inode, greatest(size, coalesce(e, size)) AS size, CASE WHEN e IS NULL THEN mtime_ns ELSE 9 END AS mtime_ns FROM nodes n LEFT JOIN ends USING (inode)"""
)
def bulk_grow(spark, d):
    return W.grow_nodes(V.nodes(spark, d), V.fragments(spark, d).withColumn("inode", 1000 + F.col("inode")), 9).select("inode", "size", "mtime_ns")


# --- telemetry -------------------------------------------------------------------------------------------------------

#: SQL writes doubles without an exponent below 1e16.
_PLAIN = 16


@query("SELECT op, count(*) AS calls, count(*) FILTER (is_error) AS errors, sum(duration_nanos)::BIGINT AS duration_nanos, sum(duration_nanos)::DOUBLE / count(*) AS avg_nanos FROM op_log GROUP BY op")
def op_stats(spark, d):
    return T.op_stats(V.op_log(spark, d))


@query("SELECT * FROM op_log WHERE duration_nanos >= 9000")
def slow_ops(spark, d):
    return T.slow_ops(V.op_log(spark, d), 9000)


_HEALTH = [(False, True, 60, 1000, 990, 1000), (True, False, 60, 1000, 0, 1000), (True, True, 0, 1000, 0, 1000), (True, True, 60, 30, 0, 1000), (True, True, 60, 62, 0, 1000), (True, True, 60, 63, 0, 1000), (True, True, 60, 1000, 930, 1000), (True, True, 60, 1000, 940, 1000)]


@query(
    """SELECT * FROM (VALUES (0, 503, 'not ready'), (1, 200, 'ok'), (2, 200, 'ok'), (3, 200, 'ok'), (4, 200, 'ok'), (5, 503, 'mover not ticking'), (6, 503, 'mover tick too old'), (7, 200, 'ok')) t(scenario, code, reason)""",
    views=False,
)
def health_status(spark, d):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_HEALTH)], "scenario int, ready boolean, has_mover boolean, max_gap_s long, uptime_s long, last_tick_s long, now_s long")
    return T.health(rows).select("scenario", "code", "reason")


@query(
    """, stats AS (SELECT op, count(*) AS calls, count(*) FILTER (is_error) AS errors, sum(duration_nanos) AS n FROM op_log GROUP BY op),
samples AS (SELECT op, 'tidemark_op_calls_total' AS name, 'Calls by operation.' AS help, calls::DOUBLE AS v FROM stats UNION ALL SELECT op, 'tidemark_op_errors_total', 'Failed calls by operation.', errors::DOUBLE FROM stats
            UNION ALL SELECT op, 'tidemark_op_duration_seconds_total', 'Total time by operation.', n::DOUBLE / 1e9 FROM stats)
SELECT name, '# HELP ' || name || ' ' || any_value(help) || chr(10) || '# TYPE ' || name || ' counter' || chr(10) || string_agg(name || '{op="' || op || '"} ' || regexp_replace(v::VARCHAR, '[.]0$', ''), chr(10) ORDER BY op) || chr(10) AS text
FROM samples GROUP BY name"""
)
def metrics_text(spark, d):
    return T.metrics_text(T.op_samples(T.op_stats(V.op_log(spark, d))), _PLAIN)


@query(
    """, usage AS (SELECT CASE tier WHEN 1 THEN 'hot' ELSE 'cold' END AS tier, count(*)::DOUBLE AS n, sum(size)::DOUBLE AS b FROM segments GROUP BY tier),
samples AS (SELECT 'tidemark_segment_count' AS name, 'Segments by tier.' AS help, tier, n AS v FROM usage UNION ALL SELECT 'tidemark_segment_bytes', 'Bytes in segments by tier.', tier, b FROM usage)
SELECT name, '# HELP ' || name || ' ' || any_value(help) || chr(10) || '# TYPE ' || name || ' gauge' || chr(10) || string_agg(name || '{tier="' || tier || '"} ' || regexp_replace(v::VARCHAR, '[.]0$', ''), chr(10) ORDER BY tier) || chr(10) AS text
FROM samples GROUP BY name"""
)
def metrics_segments(spark, d):
    return T.metrics_text(T.segment_samples(M.segment_usage(V.segments(spark, d))), _PLAIN)


# --- scalars ---------------------------------------------------------------------------------------------------------


def _values(rows: list[tuple]) -> str:
    """Rows as SQL values."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join(f"({', '.join(map(show, r))})" for r in rows)


# Sizes in bytes as text.
_SIZES = [
    ("0", 0), ("1", 1), ("1024", 1024), ("1B", 1), ("1b", 1), ("1K", 1 << 10), ("1KB", 1 << 10), ("1KiB", 1 << 10), ("1M", 1 << 20), ("500MB", 500 << 20), ("2G", 2 << 30), ("10gb", 10 << 30), ("1.5GiB", 3 << 29),
    ("1T", 1 << 40), ("500GB", 500 << 30), ("  10MiB  ", 10 << 20), ("", None), ("K", None), ("500XB", None), ("-1G", None), ("1.2.3GB", None), ("3 kb", 3 << 10), ("1p", 1 << 50), ("2PiB", 2 << 50),
]


@query(f"SELECT * FROM (VALUES {_values(_SIZES)}) t(text, bytes)", views=False)
def parse_bytes(spark, d):
    return spark.createDataFrame([(t,) for t, _ in _SIZES], "text string").select("text", S.parse_bytes(F.col("text")).alias("bytes"))


@query(
    """SELECT n, CASE WHEN n = 0 THEN '0' WHEN n % 1125899906842624 = 0 THEN (n // 1125899906842624) || 'PiB' WHEN n % 1099511627776 = 0 THEN (n // 1099511627776) || 'TiB' WHEN n % 1073741824 = 0 THEN (n // 1073741824) || 'GiB' WHEN n % 1048576 = 0 THEN (n // 1048576) || 'MiB' WHEN n % 1024 = 0 THEN (n // 1024) || 'KiB' ELSE n::VARCHAR END AS text
FROM (SELECT o_orderkey % 4096 * CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 WHEN 4 THEN 1099511627776 WHEN 5 THEN 1125899906842624 ELSE 1000 END AS n FROM orders)""",
    views=False,
)
def format_bytes(spark, d):
    """Every order's key, up to 4095 of a unit of bytes."""
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*(F.lit(1 << p).cast("long") for p in (0, 10, 20, 30, 40, 50)), F.lit(1000).cast("long")), (k % 7 + 1).cast("int"))
    return V.table(spark, d, "orders").select((k % 4096 * unit).alias("n")).select("n", S.format_bytes(F.col("n")).alias("text"))


# Cases whose results must agree.
_PATHS = [("/a/b/c.txt", "a|b|c.txt"), ("/", ""), ("", ""), ("a//b/", "a|b"), ("/a/./b/../c", "a|c"), ("/../..", ""), ("../x", "x"), ("a/b/../../c/..", "")]


@query(f"SELECT * FROM (VALUES {_values(_PATHS)}) t(path, parts)", views=False)
def path_split(spark, d):
    return spark.createDataFrame([(p,) for p, _ in _PATHS], "path string").select("path", F.array_join(S.split_path(F.col("path")), "|").alias("parts"))


# Names and whether they are valid.
_NAMES = [("", False), (".", False), ("..", False), ("a/b", False), ("ok", True), ("...", True), (" ", True)]


@query(f"SELECT * FROM (VALUES {_values(_NAMES)}) t(name, valid)", views=False)
def name_validity(spark, d):
    return spark.createDataFrame([(n,) for n, _ in _NAMES], "name string").select("name", S.valid_name(F.col("name")).alias("valid"))


_ENDPOINTS = [("collector:4318", False, "collector:4318", True), ("http://h:1", False, "h:1", True), ("https://h:2/v1", False, "h:2", False), ("https://h:2", True, "h:2", True), ("grpc://h:3", False, None, None)]


@query(f"SELECT * FROM (VALUES {_values(_ENDPOINTS)}) t(raw, override, host, insecure)", views=False)
def endpoint_parse(spark, d):
    rows = spark.createDataFrame([r[:2] for r in _ENDPOINTS], "raw string, override boolean")
    return rows.withColumn("e", S.endpoint(F.col("raw"), F.col("override"))).select("raw", "override", "e.host", "e.insecure")


@query(
    """SELECT seq, CASE tier WHEN 1 THEN 'hot' ELSE 'cold' END AS tier_name, 'tier(' || (seq % 3 + 4) || ')' AS other_tier, length + 44 AS framed, lpad(segment_id::VARCHAR, 10, '0') || '.seg' AS file, segment_id,
  CASE seq % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 39 ELSE 5 END AS errno, CASE seq % 3 WHEN 0 THEN 'warn' WHEN 1 THEN 'debug' END AS level FROM versions"""
)
def scalar_names(spark, d):
    v, s = V.versions(V.table(spark, d, "events")), F.col("seq")
    file = S.segment_file(F.col("segment_id"))
    status = F.when(s % 4 == 1, "ENOENT").when(s % 4 == 2, "ENOTEMPTY").when(s % 4 == 3, "EOTHER")
    level = F.when(s % 3 == 0, "Warning").when(s % 3 == 1, "DEBUG").otherwise("loud")
    return v.select("seq", S.tier_name(F.col("tier")).alias("tier_name"), S.tier_name(s % 3 + 4).alias("other_tier"), S.framed_size(F.col("length")).alias("framed"), file.alias("file"), S.segment_id_of(F.concat(F.lit("file:/x/"), file)).alias("segment_id"), S.errno(status).alias("errno"), S.log_level(level).alias("level"))


@query("SELECT 's' || lower(lpad(to_hex(inode), 16, '0') || lpad(to_hex(stripe_id), 8, '0') || lpad(to_hex(seq), 16, '0')) AS k FROM fragments WHERE inode >= 10 AND inode < 20")
def key_range(spark, d):
    """A range of encoded keys, from inode 10 up to the bound of the prefix of inode 19."""
    f = V.fragments(spark, d).withColumn("key", codecs.fragment_key(F.col("inode"), F.col("stripe_id"), F.col("seq")))
    low, high = codecs.STRIPE_TAG + (10).to_bytes(8, "big"), S.prefix_upper_bound(codecs.STRIPE_TAG + (19).to_bytes(8, "big"))
    found = f.where(S.in_range(F.col("key"), low, high)).where(codecs.key_kind(F.col("key")) == "fragment").sort("key")
    return found.select(F.concat(F.lit("s"), F.lower(F.hex(F.expr("substring(key, 2, 20)")))).alias("k"))


@query("SELECT inode, stripe_id, seq, logical_off, length, tier, segment_id, segment_offset FROM fragments")
def legacy_split(spark, d):
    """Fragments packed into legacy lists, one a stripe, and split again."""
    f = V.fragments(spark, d)
    value = codecs.fragment_value(*(F.col(c) for c in ("tier", "segment_id", "segment_offset", "length", "logical_off", "seq")))
    key = F.concat(F.lit(bytearray(codecs.STRIPE_TAG)), codecs.big_endian(F.col("inode"), 8), codecs.big_endian(F.col("stripe_id"), 4))
    lists = f.select(key.alias("key"), F.hex(value).alias("h")).groupBy("key").agg(F.unhex(F.array_join(F.collect_list("h"), "")).alias("value"))
    return codecs.decode_fragments(lists.where(codecs.key_kind(F.col("key")) == "legacy"))


@query(
    """SELECT 'n' || lpad(to_hex(inode), 16, '0') AS k, size AS v FROM nodes UNION ALL SELECT 'd' || lpad(to_hex(parent), 16, '0') || hex(name), child FROM dirents
UNION ALL SELECT DISTINCT 's' || lpad(to_hex(inode), 16, '0') || lpad(to_hex(stripe_id), 8, '0'), 0::BIGINT FROM fragments UNION ALL SELECT 'm', 7::BIGINT"""
)
def legacy_import(spark, d):
    """Legacy buckets as one key space: keys of nodes, entries and stripes with their tags, and the next inode."""
    as_rows = lambda rows, bucket, key, value: rows.select(F.lit(bucket).alias("bucket"), key.alias("key"), codecs.big_endian(value, 8).alias("value"))
    stripes = V.fragments(spark, d).select("inode", "stripe_id").distinct()
    rows = as_rows(V.nodes(spark, d), "nodes", codecs.big_endian(F.col("inode"), 8), F.col("size"))
    rows = rows.union(as_rows(V.dirents(spark, d), "dirents", F.concat(codecs.big_endian(F.col("parent"), 8), F.col("name").cast("binary")), F.col("child")))
    rows = rows.union(as_rows(stripes, "stripes", F.concat(codecs.big_endian(F.col("inode"), 8), codecs.big_endian(F.col("stripe_id"), 4)), F.lit(0)))
    rows = rows.union(as_rows(spark.range(1), "_l4_meta", F.lit(bytearray(b"next_inode")), F.lit(7))).union(as_rows(spark.range(1), "_l4_meta", F.lit(bytearray(b"other")), F.lit(8)))
    key = F.col("key")
    shown = F.when(key == F.lit(bytearray(codecs.NEXT_INODE_KEY)), F.lit("m")).otherwise(F.concat(F.substring(key, 1, 1).cast("string"), F.hex(F.substring(key, F.lit(2), F.length(key)))))
    return G.legacy_keys(rows).select(shown.alias("k"), codecs.from_big_endian(F.col("value"), 0, 8).alias("v"))


@query("SELECT inode, mode, nlink, uid, gid, size, mtime_ns, ctime_ns, atime_ns FROM nodes")
def node_codec(spark, d):
    return codecs.decode_nodes(V.nodes(spark, d).select(codecs.node_value().alias("value"))).drop("symlink_target")


# --- sources and streams ---------------------------------------------------------------------------------------------


def _records(spark, d):
    v = V.versions(V.table(spark, d, "events"))
    return v.withColumn("stripe_id", O.stripe_of(F.col("logical_off"), V.STRIPE)).withColumn("payload", F.expr("unhex(repeat(lpad(hex(seq % 256), 2, '0'), CAST(length AS INT)))"))


def _chunks(spark, d):
    """Every record of the table in chunks of segment files of 1 MiB, and where each lies."""
    rows = _records(spark, d)
    placed = G.pack(rows, 1 << 20)
    framed = G.frame(rows.drop("segment_id", "segment_offset").join(placed.drop("length"), ["tier", "seq"]))
    return G.chunks(framed, 1 << 16), rows.drop("segment_id", "segment_offset", "payload", "stripe_id").join(placed.drop("length"), ["tier", "seq"])


def scanned(spark, d):
    """Every record of the table as the scan of segments with junk behind gives it back."""
    chunks, _ = _chunks(spark, d)
    chunks = chunks.withColumn("segment_id", F.col("tier") * 1_000_000 + F.col("segment_id"))
    last = chunks.groupBy("segment_id").agg((F.max("chunk") + 1).alias("chunk"))
    torn = chunks.select("segment_id", "chunk", "data").union(last.select("segment_id", "chunk", F.lit(bytearray(b"junk" * 16))))
    return G.scan(torn).select("inode", "stripe_id", "seq", "logical_off", "length")


@query("SELECT inode, logical_off // 16384 AS stripe_id, seq, logical_off, length FROM versions")
def segment_scan(spark, d):
    return scanned(spark, d)


@query(
    """RECURSIVE, c AS (SELECT tier, seq, length + 44 AS size, row_number() OVER w AS i, (sum(length + 44) OVER w)::BIGINT AS upto FROM versions WINDOW w AS (PARTITION BY tier ORDER BY seq ROWS UNBOUNDED PRECEDING)),
files AS (SELECT DISTINCT tier, 1::BIGINT AS id, 1::BIGINT AS first, 0::BIGINT AS base FROM c
  UNION ALL SELECT f.tier, f.id + 1, min(i), min(upto - size) FROM files f JOIN c ON c.tier = f.tier AND i > first AND upto - base > 1048576 GROUP BY f.tier, f.id)
SELECT c.tier, seq, max(id) AS segment_id, upto - size - max(base) + 40 AS segment_offset FROM c JOIN files f ON f.tier = c.tier AND first <= i GROUP BY c.tier, seq, upto, size"""
)
def segment_rotation(spark, d):
    return G.rotate(V.versions(V.table(spark, d, "events")), 1 << 20)


@query()
def read_payloads(spark, d):
    """A digest of the bytes of one read of each inode, from the slices that segments give: stored data, and zeros in holes."""
    chunks, stored = _chunks(spark, d)
    plan = O.read_plan(stored, V.reads(spark, d), V.STRIPE)
    return O.read_digests(O.read_slices(plan, chunks, 1 << 16))


ORACLE["read_payloads"] = (
    "WITH " + V.SQL.strip() + _PLAN.format(source="versions").replace("SELECT m.read_id, s AS logical_off, e - s AS length, m.seq IS NULL AS sparse, tier, segment_id, base + s AS segment_offset", "SELECT m.read_id, md5(string_agg(repeat(CASE WHEN m.seq IS NULL THEN '00' ELSE lpad(to_hex(m.seq % 256), 2, '0') END, (e - s)::INT), '' ORDER BY s)) AS digest").rsplit("FROM m LEFT JOIN", 1)[0] + "FROM m GROUP BY m.read_id"
)


def _stream(spark, d):
    source = V.table(spark, d, "events")
    return spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("SELECT inode, stripe_id, seq, logical_off, length, tier, segment_id, segment_offset FROM fragments")
def stream_flush(spark, d):
    """Events flushed as a stream, and what the store holds after it has drained."""
    store = scratch(spark, "flush")
    L.flush(V.versions(_stream(spark, d)), f"{store}/data", f"{store}/checkpoint", V.STRIPE).awaitTermination()
    columns = ["inode", "stripe_id", "seq", "logical_off", "length", "tier", "segment_id", "segment_offset"]
    return spark.read.parquet(f"{store}/data").select(*columns)


@query("SELECT epoch_ms(date_trunc('hour', ts))::BIGINT // 1000 AS start, event_type, count(*) AS events FROM events GROUP BY ALL", views=False)
def stream_windows(spark, d):
    store = scratch(spark, "windows")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/data")

    counts = L.windowed_counts(_stream(spark, d)).select(F.unix_timestamp("w.start").alias("start"), "event_type", "events")
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{store}/data")


@query("SELECT 1000 + user_id AS inode, max(event_id * 7919 % 65536 + 1) AS live_size, max(event_id * 1000000000) AS live_mtime_ns FROM events GROUP BY user_id", views=False)
def stream_live(spark, d):
    """Live attributes kept over a stream of writes, a row an inode."""
    store = scratch(spark, "live")
    pending = _stream(spark, d).select((1000 + F.col("user_id")).alias("inode"), (F.col("event_id") * 7919 % 65536).alias("logical_off"), F.lit(1).alias("length"), (F.col("event_id") * 1_000_000_000).alias("mtime_ns"), F.col("event_id").alias("seq"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/data")

    L.live_attributes(pending).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{store}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{store}/data")
