import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import maintenance as M, namespace as N, writes as W
from tidemark.plans.ordered import row_numbers, running_total
from tidemark.schemas import DIRENTS, FRAGMENTS, NODES, SEGMENTS
from tidemark.sources import segments as G
from tidemark.streaming import flush as L

DIR, FILE, LINK = 0o040755, 0o100644, 0o120777


def nodes(spark, rows):
    return spark.createDataFrame([(i, m, n, 0, 0, 0, 1, 1, 1, None) for i, m, n in rows], NODES)


@pytest.fixture(scope="module")
def tree(spark):
    """/a/b/f and /g, with an entry to nowhere."""
    return spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, "f", 4), (1, "g", 5), (1, "gone", 99)], DIRENTS), nodes(spark, [(1, DIR, 3), (2, DIR, 3), (3, DIR, 2), (4, FILE, 1), (5, FILE, 1)])


def status(df):
    return {r.request_id: r.status for r in df.collect()}


def test_paths(spark, tree):
    paths = ["/a/b/f", "/", "/a/x", "/g/x", "/a/../g", "/gone/x"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("parts", S.split_path(F.col("path")))
    assert {r.path: (r.inode, r.status) for r in N.walk_paths(rows, *tree).collect()} == {"/a/b/f": (4, 0), "/": (1, 0), "/a/x": (None, 2), "/g/x": (None, 20), "/a/../g": (5, 0), "/gone/x": (None, 5)}


def test_lookup_dangling(spark, tree):
    asked = spark.createDataFrame([(1, "gone"), (1, "nope"), (1, ".."), (1, "a")], "parent long, name string")
    assert {r.name: r.status for r in N.lookup(asked, *tree).collect()} == {"gone": 5, "nope": 2, "..": 22, "a": 0}


def test_edits(spark, tree):
    d, n = tree
    made = spark.createDataFrame([(1, "dir", 1, "new", 0o700, None), (2, "file", 1, "new", 0o600, None), (3, "symlink", 2, "s", 0, "héllo"), (4, "file", 5, "x", 0, None), (5, "file", 77, "x", 0, None)], "request_id long, kind string, parent long, name string, mode int, target string").withColumn("uid", F.lit(0).cast("long")).withColumn("gid", F.lit(0).cast("long"))
    result, d2, n2 = N.create(made, d, n, 100, 9)
    assert status(result) == {1: 0, 2: 17, 3: 0, 4: 20, 5: 2}
    by = {r.inode: r for r in n2.collect()}
    assert by[1].nlink == 4 and by[100].mode == 0o040700 and by[101].mode == LINK and by[101].size == 6
    assert {r.inode: r.target for r in N.readlink(spark.createDataFrame([(101,), (4,), (555,)], "inode long"), n2).collect()} == {101: "héllo", 4: None, 555: None}
    asked = spark.createDataFrame([(1, 4, 1, "h"), (2, 2, 1, "d"), (3, 4, 5, "x")], "request_id long, inode long, parent long, name string")
    result, d3, n3 = N.link(asked, d, n, 9)
    assert status(result) == {1: 0, 2: 1, 3: 20}
    gone = spark.createDataFrame([(1, 3, "f"), (2, 1, "a"), (3, 1, "no")], "request_id long, parent long, name string")
    result, _, n4, freed = N.unlink(gone, d3, n3, 9)
    assert status(result) == {1: 0, 2: 21, 3: 2} and freed.count() == 0 and {r.inode: r.nlink for r in n4.collect()}[4] == 1
    _, _, n5, freed = N.unlink(gone, d, n, 9)
    assert [r.inode for r in freed.collect()] == [4] and n5.where("inode = 4").count() == 0
    result, _, n6 = N.rmdir(spark.createDataFrame([(1, 2, "b"), (2, 1, "g")], "request_id long, parent long, name string"), d, n, 9)
    assert status(result) == {1: 39, 2: 20}


def test_rename_order_of_checks(spark, tree):
    d, n = tree
    asked = spark.createDataFrame(
        [(1, 1, "a", 3, "x"), (2, 1, "g", 2, "b"), (3, 1, "a", 1, "g"), (4, 3, "f", 1, "g"), (5, 1, "g", 1, "g"), (6, 1, "no", 1, "y"), (7, 1, "", 1, "y"), (8, 1, "g", 4, "y"), (9, 1, "a", 2, "b")],
        "request_id long, old_parent long, old_name string, new_parent long, new_name string",
    )
    result, after, _, _ = N.rename(asked, d, n, 9)
    assert status(result) == {1: 22, 2: 21, 3: 20, 4: 0, 5: 0, 6: 2, 7: 22, 8: 20, 9: 22}
    assert {(r.parent, r.name): r.child for r in after.collect()}[1, "g"] == 4


def test_renames_of_one_batch(spark):
    """One source twice, one target twice, directories into each other, a chain, and what is overwritten."""
    d = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (1, "f", 4), (1, "g", 5), (1, "h", 6), (1, "e", 7), (2, "k", 5), (1, "gone", 99)], DIRENTS)
    n = nodes(spark, [(1, DIR, 5), (2, DIR, 2), (3, DIR, 2), (4, FILE, 1), (5, FILE, 2), (6, FILE, 1), (7, DIR, 2)])
    shape = "request_id long, old_parent long, old_name string, new_parent long, new_name string"

    def run(*rows):
        result, after, n2, freed = N.rename(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], shape), d, n, 9)
        return status(result), {(r.parent, r.name): r.child for r in after.collect()}, {r.inode: (r.nlink, r.ctime_ns) for r in n2.collect()}, {r.inode for r in freed.collect()}

    s, e, _, _ = run((1, "f", 1, "x"), (1, "f", 1, "y"))
    assert s == {0: 0, 1: 2} and e[1, "x"] == 4 and (1, "y") not in e
    s, e, _, _ = run((1, "a", 3, "m"), (1, "b", 2, "n"))
    assert s == {0: 0, 1: 11} and e[3, "m"] == 2 and e[1, "b"] == 3
    s, e, _, _ = run((1, "f", 1, "z"), (1, "h", 1, "z"))
    assert s == {0: 0, 1: 11} and e[1, "z"] == 4 and e[1, "h"] == 6
    s, e, left, freed = run((1, "f", 1, "h"), (1, "h", 1, "q"))
    assert s == {0: 0, 1: 11} and e[1, "h"] == 4 and freed == {6} and 6 not in left
    s, e, left, freed = run((1, "f", 1, "g"), (1, "a", 1, "gone"), (1, "b", 1, "e"))
    assert s == {0: 0, 1: 5, 2: 0} and freed == set() and left[5] == (1, 9) and left[1] == (4, 9) and 7 not in left and e[1, "e"] == 3
    s, e, left, freed = run((1, "b", 2, "e"), (1, "f", 7, "in"), (1, "a", 1, "e"))
    assert s == {0: 0, 1: 0, 2: 11} and left[1] == (4, 9) and left[2] == (3, 9)
    s, *_ = run((1, "gone", 1, "x"), (1, "..", 1, "x"), (1, "e", 1, "e"))
    assert s == {0: 5, 1: 22, 2: 0}


def test_dangling_entries_and_names(spark, tree):
    asked = spark.createDataFrame([(1, 1, "gone"), (2, 1, ".."), (3, 3, "f"), (4, 3, "f"), (5, 2, "b"), (6, 2, "b")], "request_id long, parent long, name string")
    assert status(N.unlink(asked, *tree, 9)[0]) == {1: 5, 2: 22, 3: 0, 4: 2, 5: 21, 6: 21}
    assert status(N.rmdir(asked, *tree, 9)[0]) == {1: 5, 2: 22, 3: 20, 4: 20, 5: 39, 6: 39}


def test_mover_loop():
    waits, left = [], iter([False, True, True, True, False, None])
    failing = {"now": False}

    def stop(delay):
        waits.append(delay)
        failing["now"] = next(left)
        return failing["now"] is None

    def once():
        if failing["now"]:
            raise ValueError("a pass")

    assert M.loop(once, 30, 100, stop) == {"passes": 5, "failed": 3, "consecutive_errors": 0}
    assert waits == [30, 30, 60, 100, 100, 30]


def test_mover_samples(spark):
    from tidemark.operators import telemetry as T

    runs = spark.createDataFrame([(10, False, 1, 1, 2, 0, 500, 7, 3), (20, True, 1, 0, 0, 1, 0, 0, 0), (30, True, 1, 0, 0, 1, 0, 0, 0)], "tick_s long, failed boolean, evicts long, gcs long, moves_ok long, moves_failed long, bytes_moved long, move_nanos long, gc_nanos long")
    text = {r.name: r.text for r in T.metrics_text(T.mover_samples(M.mover_summary(runs))).collect()}
    assert len(text) == 10 and text["tidemark_mover_consecutive_errors"].endswith("gauge\ntidemark_mover_consecutive_errors 2\n")
    assert text["tidemark_mover_bytes_moved"].endswith("tidemark_mover_bytes_moved 500\n") and text["tidemark_mover_last_error_s"].endswith(" 30\n")


def test_evict_and_gc(spark):
    stripes = spark.createDataFrame([(1, k, 10, 0, 10) for k in range(4)], "inode long, stripe_id long, hot_bytes long, cold_bytes long, live_bytes long")
    assert M.evict_candidates(stripes, 20, 10, 9).count() == 3
    assert M.evict_candidates(stripes, 20, 0).count() == 0 and M.evict_candidates(stripes, 5, 10).count() == 0
    assert M.evict_candidates(stripes, 20, 10, 30).count() == 1 and M.default_target(99) == 79
    f = spark.createDataFrame([(1, 0, s, 0, 10, 1, s, 0) for s in (1, 2)], FRAGMENTS)
    segments = spark.createDataFrame([(1, 1, 54, False), (1, 2, 54, False), (1, 3, 0, True)], SEGMENTS)
    assert [r.segment_id for r in M.gc_segments(segments, M.compact(f, f, 1, 50).where("NOT moved")).collect()] == [1]
    after, garbage = M.run_once(f, segments, 1, 100)
    assert {(r.tier, r.seq) for r in after.collect()} == {(2, 100)} and {r.segment_id for r in garbage.collect()} == {1, 2}


def test_compact_where_a_join_turns_into_a_broadcast(spark):
    """The join's exchange by (inode, stripe) is not read by key then; the sweep still needs each key in one partition."""
    row = F.col("id")
    f = spark.range(0, 4000, 1, 4).select((row % 5).alias("inode"), (row % 2).alias("stripe_id"), (row + 1).alias("seq"), (row * 7919 % 900).alias("logical_off"), F.lit(100).cast("long").alias("length"), F.lit(1).cast("tinyint").alias("tier"), row.alias("segment_id"), F.lit(0).cast("long").alias("segment_offset"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pieces = M.compact(f, f.where("inode < 3"), 2, 10_000).where("inode < 3").collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    newest = {}
    for k in range(4000):
        newest.update({(k % 5, k % 2, b): k for b in range(k * 7919 % 900, k * 7919 % 900 + 100)})
    shown = [((r.inode, r.stripe_id, b), r.segment_id) for r in pieces for b in range(r.logical_off, r.logical_off + r.length)]
    assert len(shown) == len(dict(shown)) and dict(shown) == {k: v for k, v in newest.items() if k[0] < 3}


def test_ordered(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert all(r.n == r.k + 5 for r in row_numbers(rows, ["k"], "n", 5).collect())
    assert all(r.b == r.k * (r.k - 1) // 2 for r in running_total(rows, ["k"], F.col("k"), "b").collect())
    assert running_total(rows.limit(0), ["k"], F.col("k"), "b").count() == 0


def test_segments(spark, tmp_path):
    rows = spark.createDataFrame([(1, 9, 0, s, 10 * s, bytearray(b"x" * 80)) for s in (1, 2, 3)], "tier tinyint, inode long, stripe_id long, seq long, logical_off long, payload binary").withColumn("length", F.lit(80).cast("long"))
    placed = G.rotate(rows, 100)
    assert [r.segment_id for r in placed.sort("seq").collect()] == [1, 2, 3]
    framed = G.frame(rows.drop("length").join(G.rotate(rows, 1000), ["tier", "seq"]))
    whole = G.chunks(framed, 100).drop("tier")
    data = b"".join(bytes(r.data) for r in whole.sort("chunk").collect())
    assert len(data) == 3 * 124 and whole.count() == 4

    def chunks(content, size=100):
        return spark.createDataFrame([(1, k // size, bytearray(content[k : k + size])) for k in range(0, len(content), size)], "segment_id long, chunk long, data binary")

    for torn, n in ((data + b"q" * 16, 3), (data[:-1], 2), (data[:-130], 1)):
        assert [r.seq for r in G.scan(chunks(torn)).sort("seq").collect()] == [1, 2, 3][:n]
        assert G.good_sizes(chunks(torn)).first().good_size == 124 * n
        assert b"".join(bytes(r.data) for r in G.repaired(chunks(torn), 100).sort("chunk").collect()) == data[: 124 * n]
    assert G.scan(chunks(data[:199] + b"Z" + data[200:])).count() == 1
    assert G.scan(whole.where("chunk <> 1")).count() == 0
    G.write_files(whole, str(tmp_path))
    (tmp_path / "x.seg").write_bytes(b"")
    (tmp_path / "99999999999.seg").write_bytes(b"")
    assert [tuple(r) for r in G.discover(spark, str(tmp_path)).collect()] == [(1, 372, True)]
    assert G.scan(G.load(spark, str(tmp_path), 50)).count() == 3
    G.write_files(whole.withColumn("segment_id", F.lit(2)), str(tmp_path))
    assert [r.segment_id for r in G.stray_files(spark, str(tmp_path), whole.where("segment_id = 2")).collect()] == [1]
    assert G.remove_files(spark, str(tmp_path), whole.select("segment_id")) == 1 and not (tmp_path / "0000000001.seg").exists()
    assert not G.import_table(spark, str(tmp_path / "none"), str(tmp_path / "out"), ["seq"])


def test_legacy_import(spark, tmp_path):
    rows = spark.createDataFrame([("nodes", bytearray(8), bytearray(b"v")), ("other", bytearray(1), bytearray(b"w"))], "bucket string, key binary, value binary")
    rows.write.parquet(str(tmp_path / "old"))
    assert G.import_table(spark, str(tmp_path / "old"), str(tmp_path / "new")) and (tmp_path / "old.migrated").exists()
    assert [bytes(r.key) for r in spark.read.parquet(str(tmp_path / "new")).collect()] == [b"n" + bytes(8)]
    assert not G.import_table(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    rows.write.parquet(str(tmp_path / "old"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        G.import_table(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    for bucket, key in (("nodes", bytearray(9)), ("dirents", bytearray(7)), ("stripes", bytearray(8))):
        with pytest.raises(Exception, match=f"{bucket} key of length"):
            G.legacy_keys(spark.createDataFrame([(bucket, key, bytearray())], rows.schema)).collect()


def test_writes(spark):
    bulk = W.BulkSession(16)
    bulk.write(spark.createDataFrame([(1, 5, 10, 20, 0, 0), (2, 5, 0, 0, 0, 0)], "arrival long, inode long, logical_off long, length long, segment_id long, segment_offset long"))
    empty = spark.createDataFrame([], FRAGMENTS)
    got = bulk.commit(empty, 70).sort("seq").collect()
    assert [(r.seq, r.stripe_id, r.logical_off, r.length) for r in got] == [(70, 0, 10, 6), (71, 1, 16, 14)]
    bulk.abort()
    assert bulk.commit(empty, 1).count() == 0
    bad = spark.createDataFrame([(1, 0, 1, 10, 10, 1, 0, 0)], FRAGMENTS)
    with pytest.raises(Exception, match="crosses a stripe"):
        W.append_batch(bad, 16).collect()
    assert W.straddling(bad, 16).count() == 1


@pytest.mark.parametrize("value,text", [(0.0, "0"), (350.0, "350"), (1e6, "1e+06"), (123456.0, "123456"), (1234567.5, "1.2345675e+06"), (0.00035, "0.00035"), (0.000012, "1.2e-05"), (-2.5, "-2.5"), (1e21, "1e+21"), (0.1, "0.1"), (1.5e-7, "1.5e-07"), (100000.0, "100000")])
def test_number(spark, value, text):
    assert spark.range(1).select(S.number(F.lit(value)).alias("t")).first().t == text


@pytest.mark.parametrize("value,text", [(0.0, "0"), (1e6, "1000000"), (186153030.0, "186153030"), (1234567.5, "1234567.5"), (-2.5e7, "-25000000"), (12345678.25, "12345678.25"), (1e15, "1000000000000000"), (1e16, "1e+16"), (0.00035, "0.00035"), (0.000012, "1.2e-05")])
def test_number_with_a_later_exponent(spark, value, text):
    assert spark.range(1).select(S.number(F.lit(value), 16).alias("t")).first().t == text


def test_prefix_bound():
    assert S.prefix_upper_bound(b"ab") == b"ac" and S.prefix_upper_bound(b"a\xff") == b"b" and S.prefix_upper_bound(b"\xff\xff") is None


def test_stream_retry_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, 0, 40, 1, 0, 0)], "seq long, inode long, logical_off long, length long, tier int, segment_id long, segment_offset long")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):
        L.flush(source, str(tmp_path / "store"), str(tmp_path / "checkpoint"), 16, on_commit=lambda b, i: seen.append(b.count())).awaitTermination()
    assert seen == [3] and spark.read.parquet(str(tmp_path / "store")).count() == 3


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "session"])
def test_windows(spark, kind):
    events = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:00"), ("a", "2024-01-01 05:00:00")], "event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert L.windowed_counts(events, kind).agg(F.sum("events")).first()[0] == (12 if kind == "sliding" else 3)


def test_every_record_is_scanned(spark):
    from tidemark.plans import queries as Q, views as V

    d = "/root/testdata/sf0.001"
    columns = ["inode", "seq", "logical_off", "length"]
    expected = V.versions(V.table(spark, d, "events")).select(*columns).collect()
    assert sorted(map(tuple, Q.scanned(spark, d).select(*columns).collect())) == sorted(map(tuple, expected))
