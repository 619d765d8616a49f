"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A document's set is its distinct shingles of `width` words (fewer words: the whole sequence is one shingle). Its signature
has 36 symbols of 16 bits, one for each MinHash function, in 6 chunks of 6. Two signatures at a distance of at most 17
differing symbols have a chunk with at most 2 errors, so the join enumerates, for each chunk, the 15 ways to leave out 2 of
its 6 symbols: such a pair surely shares a key. At a Jaccard similarity of 0.8 a pair shares none of the 90 keys with a
chance under one in a million.

Equal sets are collapsed to classes first, by a 128-bit hash of the set; the nodes below are classes. All nodes that share a
key, directly or through others, are one family, whatever their sizes and distances.

1. Stars. Within a key each node has the least node of its own and of the next band of sizes as hubs. A node is confirmed
   against the one hub that it shares the most keys with: one comparison a node, which joins nearly all of a group of near
   copies however large it is.
2. Units. Where a family then lies in several components, the nodes outside the largest meet each other and its nodes in
   units of two blocks of at most about BLOCK nodes; a family of over SPARSE blocks in which few nodes share keys is cut into
   its keys first, if that sends fewer rows. A pair of different components is ruled out by sizes or by a sketch (the least
   hash of each of 256 ranges, cut to 8 bits: SLACK standard errors under the threshold, under one in 10^8 for a pair at it),
   or is confirmed in the unit, likeliest first, until earlier links have joined it. Only links leave a unit, so the pairs
   somewhat under the threshold, which are many where texts share most of their words, are never written.

A set of over FULL shingles comes to a unit as its FULL least hashes, an unbiased sample; pairs that the sample doesn't rule
out by SLACK standard errors leave the unit to be confirmed on full sets, and count as joined there only if it is as far over
the threshold. Components come from least-neighbour labels with pointer jumping on ever fewer edges, a written table each
round. Nothing about documents reaches the driver but counts.

Defined results: null and empty texts and texts of white space alone have an empty set and are linked with nothing; a row
without an id keeps a null component and is kept; each row's text counts on its own, also where rows repeat an id, in
whatever order; dedup() drops an id only if no row of it is kept; an empty table gives an empty result; other columns don't
matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import passing

from .common import bounded, by_batch, by_group, cut

PERCENT = 80
CHUNKS, CHUNK, ERRORS = 6, 6, 2
SYMBOLS = CHUNKS * CHUNK
#: Signatures up to this distance are guaranteed to share a key.
RADIUS = (ERRORS + 1) * CHUNKS - 1
#: A star's pair is confirmed up to this distance; farther ones are left to the later rounds.
MAX_DISTANCE = RADIUS + 4
_LONGS = SYMBOLS // 4
_SIGNATURE = [f"s{k}" for k in range(_LONGS)]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240607).integers(1, 2**63, size=(2, SYMBOLS), dtype=np.uint64)
_XOR, _FACTOR = _SEEDS[0], _SEEDS[1] * np.uint64(2) + np.uint64(1)
BLOCK, SPARSE, FULL, SKETCH, SLACK = 1024, 16, 2048, 256, 6
_WORDS_KEPT, _BLOCK = 200_000, 1 << 15


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; words are runs of what isn't ASCII white space, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed(out * _MIX + h[k : k + len(out)])
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """The least hash under each function, cut to 16 bits."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), _BLOCK):
        least = np.minimum(least, ((found[k : k + _BLOCK, None] ^ _XOR) * _FACTOR).min(axis=0))
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def _profiled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, sig = [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), width)
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                n.append(len(found))
                hi.append((digest >> 64) - 2**63)
                lo.append((digest & (2**64 - 1)) - 2**63)
                sig.append(signature(found))
            longs = np.array(sig, np.uint16).reshape(-1, SYMBOLS).view(np.int64)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), *(pa.array(longs[:, k]) for k in range(_LONGS))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "hi", "lo", *_SIGNATURE])

    return run


def profiles(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, n (set size), hi and lo (the set's 128-bit hash) and the signature in longs."""
    schema = "id long, n long, hi long, lo long, " + ", ".join(f"{c} long" for c in _SIGNATURE)
    return by_batch(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), _profiled(width), schema)


_KEPT = [list(c) for c in combinations(range(CHUNK), CHUNK - ERRORS)]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        longs = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(_LONGS)], axis=1)
        symbols = np.ascontiguousarray(longs).view(np.uint16).astype(np.uint64).reshape(-1, CHUNKS, CHUNK)
        ids = batch.column(0)
        for c in range(CHUNKS):
            for k, kept in enumerate(_KEPT):
                packed = np.zeros(len(symbols), np.uint64)
                for j in kept:
                    packed = packed << np.uint64(16) | symbols[:, c, j]
                key = _mixed(packed ^ _mixed(np.full(1, c * len(_KEPT) + k + 1, np.uint64) * _MIX))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids], names=["key", "node"])


def _distance(a: str, b: str) -> Column:
    """Differing symbols of two signatures: each 16-bit lane is folded into its lowest bit."""
    total = F.lit(0)
    for s in _SIGNATURE:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        for shift, mask in ((8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return total


def _alike(a: str, b: str, percent: int) -> Column:
    """Pairs worth a confirmation: neither the sizes nor the signatures rule the similarity out."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 100 >= large * percent) & (_distance(a, b) <= MAX_DISTANCE)


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for each node of the edges a, b.

    Each round points every node to its least neighbour, follows the pointers to their ends, and keeps the edges between
    different ends, of which there are soon few.
    """
    left, labels = cut(edges.select("a", "b").distinct(), "edges"), None
    while True:
        both = left.union(left.select("b", "a"))
        up = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "pointers")
        while True:
            end = up.select(F.col("node").alias("at"), F.col("up").alias("further"))
            after = cut(up.join(end, up["up"] == end["at"]).select("node", F.col("further").alias("up"), (F.col("further") != up["up"]).alias("moved")), "pointers")
            up = after.select("node", "up")
            if after.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.select("node", F.col("up").alias("component"))
        else:
            end = up.select(F.col("node").alias("component"), "up")
            labels = cut(labels.join(end, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        x, y = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        left = cut(left.join(x, "a").join(y, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        if left.isEmpty():
            return labels


def sketch(found: np.ndarray) -> bytes:
    """For each of SKETCH equal ranges of hashes, 8 bits of the least hash of a sorted set in it; 0 where it has none."""
    width = 2**64 // SKETCH
    at = np.minimum(np.searchsorted(found, np.arange(SKETCH, dtype=np.uint64) * np.uint64(width)), len(found) - 1)
    least = found[at]
    inside = least // np.uint64(width) == np.arange(SKETCH, dtype=np.uint64)
    return np.where(inside, _mixed(least) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                found = [shingle_set(t.as_py(), width) for t in part.column(1)]
                digests = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in found]
                ends = np.cumsum([0, *map(len, found)])
                values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
                columns = [part.column(0), pa.array([(d >> 64) - 2**63 for d in digests], pa.int64()), pa.array([(d & (2**64 - 1)) - 2**63 for d in digests], pa.int64()), values]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "hi", "lo", "shingles"])

    return run


def _full_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """node and shingles of the nodes wanted (node, id, hi, lo), from a document of each class."""
    wanted = bounded(wanted, "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted.select("id"), "id", "left_semi")
    found = by_batch(texts, _sets(width), "id long, hi long, lo long, shingles array<long>")
    return cut(found.join(wanted, ["id", "hi", "lo"]).select("node", "shingles").dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar enough."""
    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(shared * 100 >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


class _Unit:
    """The nodes of a unit with their sets, or what is known of them, and the components as its links join them."""

    def __init__(self, unit: pa.RecordBatch, percent: int, full: int) -> None:
        self.percent, self.p = percent, percent / 100
        self.node, comp, self.n = (unit.column(k).to_numpy(zero_copy_only=False) for k in (4, 5, 6))
        _, self.label = np.unique(comp, return_inverse=True)
        lists = unit.column(7)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        hashes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.sets = [hashes[a:b] for a, b in zip(ends, ends[1:])]
        self.whole = self.n <= full
        blank = bytes(SKETCH)
        self.marks = np.frombuffer(b"".join(sketch(x) if w else blank for x, w in zip(self.sets, self.whole)), np.uint8).reshape(-1, SKETCH)

    def least(self, n: np.ndarray | int) -> np.ndarray | float:
        return SLACK * np.sqrt(self.p * (1 - self.p) / n)

    def shares(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimated similarities; -1 for pairs ruled out, 1 where a set isn't whole."""
        out = np.empty(len(a))
        for k in range(0, len(a), 1 << 16):
            x, y = self.marks[a[k : k + (1 << 16)]], self.marks[b[k : k + (1 << 16)]]
            either = np.maximum(np.count_nonzero(x | y, axis=1), 1)
            share = np.count_nonzero((x == y) & (x != 0), axis=1) / either
            out[k : k + (1 << 16)] = np.where(share >= self.p - self.least(either), share, -1)
        out[~(self.whole[a] & self.whole[b])] = 1
        return out

    def join(self, a: int, b: int) -> None:
        self.label[self.label == self.label[b]] = self.label[a]

    def linked(self, a: int, some: np.ndarray) -> np.ndarray:
        """Which of the whole sets are similar to that of a."""
        own, sizes = self.sets[a], self.n[some]
        all_of = np.concatenate([self.sets[b] for b in some])
        hit = own[np.minimum(np.searchsorted(own, all_of), len(own) - 1)] == all_of
        shared = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
        return shared * 100 >= self.percent * (len(own) + sizes - shared)

    def sampled(self, a: int, b: int) -> float:
        """How far over the threshold the samples of two sets are, in standard errors."""
        x, y = self.sets[a], self.sets[b]
        upto = min((s[-1] for s, w in ((x, self.whole[a]), (y, self.whole[b])) if not w))
        x, y = (s[: np.searchsorted(s, upto, side="right")] for s in (x, y))
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return (shared / (either := len(x) + len(y) - shared) - self.p) / (self.least(either) / SLACK)


def _linked(percent: int, full: int):
    """Links a, b of a unit between different components, and pairs that are yet to be confirmed (sure is false).

    A unit's left nodes meet each other, or its right nodes if it has any. Likely pairs come first, one by one, and join their
    components; then each node meets all that are left for it at once.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        unit, is_left = _Unit(batch, percent, full), batch.column(3).to_numpy(zero_copy_only=False)
        rows, columns = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        alone = not len(columns)
        columns, n = rows if alone else columns, unit.n
        fits = np.minimum.outer(n[rows], n[columns]) * 100 >= np.maximum.outer(n[rows], n[columns]) * percent
        fits &= unit.label[rows][:, None] != unit.label[columns][None, :]
        if alone:
            fits &= np.less.outer(rows, columns)
        i, j = np.nonzero(fits)
        a, b = rows[i], columns[j]
        share = unit.shares(a, b)
        whole, out = unit.whole[a] & unit.whole[b], []

        def meet(x: int, y: int) -> None:
            if not (unit.whole[x] and unit.whole[y]):
                over = unit.sampled(x, y)
                if over > -SLACK:
                    out.append((x, y, False))
                if over > SLACK:
                    unit.join(x, y)
            elif unit.linked(x, np.array([y]))[0]:
                out.append((x, y, True))
                unit.join(x, y)

        likely = np.flatnonzero((share >= (1 + percent / 100) / 2) | ~whole)
        likely = likely[np.argsort(-share[likely], kind="stable")]
        while len(likely):
            for k in likely[:1024].tolist():
                if unit.label[a[k]] != unit.label[b[k]]:
                    meet(int(a[k]), int(b[k]))
            likely = likely[1024:]
            likely = likely[unit.label[a[likely]] != unit.label[b[likely]]]
        rest = np.flatnonzero((share >= 0) & whole)
        a, b = a[rest], b[rest]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else []
        for s, e in zip(starts, [*starts[1:], len(a)]):
            x, some = int(a[s]), b[s:e]
            some = some[unit.label[some] != unit.label[x]]
            for k in range(0, len(some), 512):
                for y in some[k : k + 512][unit.linked(x, some[k : k + 512])].tolist():
                    if unit.label[x] != unit.label[y]:
                        out.append((x, y, True))
                        unit.join(x, y)
        if not out:
            return None
        x, y, sure = (np.array(v) for v in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(unit.node[x]), pa.array(unit.node[y]), pa.array(sure)], names=["a", "b", "sure"])

    return run


def _shape(members: DataFrame) -> DataFrame:
    """family, main (its largest component), few and many (the others' nodes and its own, in blocks), sent (rows of its
    units), nodes: of the families that hold several components."""
    each = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("m"))
    shape = each.groupBy("family").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("nodes"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    shape = shape.select("family", "nodes", F.col("top.component").alias("main"), blocks(F.col("nodes") - F.col("top.m")).alias("few"), blocks(F.col("top.m")).alias("many"), F.col("top.m").alias("m"))
    return shape.withColumn("sent", (F.col("nodes") - F.col("m")) * (F.col("few") + F.col("many")) + F.col("m") * F.col("few"))


def _units(members: DataFrame, shared: DataFrame) -> DataFrame:
    """family, x, y, left, node, component: members (family, node, component) in the units where they meet.

    The nodes of a family's largest component never meet, so a family of near copies that are linked already costs nothing.
    """
    shape = bounded(_shape(members), "shape")
    placed = members.join(shape, "family")
    large = shape.where(F.col("nodes") > SPARSE * BLOCK)
    if not large.isEmpty():
        # Keys with the same nodes are one. A key stands in for its family under its own number.
        by_key = cut(shared.join(placed.join(large.select("family"), "family", "left_semi").select("family", "node", "component", "sent"), "node"), "by-key")
        prints = by_key.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("print")).where("low < high")
        by_key = cut(by_key.join(prints.groupBy("print", "m").agg(F.min("key").alias("key")).select("key"), "key"), "by-key")
        keyed = by_key.select(F.col("key").alias("family"), "node", "component")
        sizes = _shape(keyed).select(F.col("family").alias("key"), F.col("sent").alias("of_key"))
        sparse = by_key.select("key", "family", F.col("sent")).distinct().join(sizes, "key").groupBy("family").agg(F.sum("of_key").alias("keys"), F.max("sent").alias("sent")).where("keys < sent")
        sparse = bounded(sparse.select("family"), "sparse")
        chosen = by_key.join(sparse, "family", "left_semi").select(F.col("key").alias("family"), "node", "component")
        chosen = chosen.join(bounded(_shape(chosen), "shape-of-keys"), "family")
        placed = placed.join(sparse, "family", "left_anti").unionByName(chosen)
    is_main = F.col("component") == F.col("main")
    placed = placed.withColumn("at", F.pmod(F.xxhash64("node"), F.when(is_main, F.col("many")).otherwise(F.col("few"))).cast("int"))
    # y below 0 stands for block -1 - y of the largest component
    to_main = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda k: F.struct(F.col("at").alias("x"), (-1 - k).alias("y"), F.lit(True).alias("left")))
    to_few = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda k: F.struct(F.least("at", k).alias("x"), F.greatest("at", k).alias("y"), (F.col("at") <= k).alias("left")))
    of_main = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda k: F.struct(k.alias("x"), (-1 - F.col("at")).alias("y"), F.lit(False).alias("left")))
    goes = F.when(is_main, of_main).otherwise(F.concat(to_main, to_few))
    return placed.withColumn("u", F.explode(goes)).select("family", "u.x", "u.y", "u.left", "node", "component")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles, component_id, kept for each row of docs."""
    with passing(docs.sparkSession) as keep:
        rows = keep(cut(profiles(docs, id_col, text_col, width), "profiles"))
        classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("hi", "lo").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), *(F.max(s).alias(s) for s in _SIGNATURE))
        # The numbers hold from here on, since the table is written and read back.
        classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
        # n shared of n + 1 is the most that different sets of n or more can have in common.
        able = classes.where(F.col("n") * 100 >= percent * (F.col("n") + 1))
        keys = by_batch(able.select("node", *_SIGNATURE), _keyed, "key long, node long")
        several = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
        shared = cut(keys.join(several.select("key", "low"), "key").join(able.select("node", band.alias("band")), "node"), "shared-keys")

        hubs = shared.groupBy("key", "band").agg(F.min("node").alias("hub"))
        both = bounded(hubs.union(hubs.select("key", F.col("band") - 1, "hub")), "hubs")
        votes = shared.join(both, ["key", "band"]).where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("keys"))
        partner = votes.groupBy("node").agg(F.max(F.struct("keys", (-F.col("hub")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), F.col("node").alias("b"))
        side = able.select("node", "n", *_SIGNATURE)
        tried = cut(partner, "stars").join(side.alias("x"), F.col("x.node") == F.col("a")).join(side.alias("y"), F.col("y.node") == F.col("b"))
        tried = tried.where(_alike("x", "y", percent)).select("a", "b")
        family = components(shared.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")))

        sets = _full_sets(classes.join(family.select("node"), "node", "left_semi").select("node", "id", "hi", "lo"), docs, id_col, text_col, width)
        links = cut(_confirmed(tried, sets, percent), "links")
        found = components(links)
        members = cut(family.withColumnRenamed("component", "family").join(found, "node", "left").select("family", "node", F.coalesce("component", "node").alias("component")), "members")
        known = sets.select("node", F.size("shingles").cast("long").alias("n"), F.slice("shingles", 1, FULL).alias("low"))
        units = _units(members, shared.select("key", "node")).join(known, "node")
        more = cut(by_group(units.select("family", "x", "y", "left", "node", "component", "n", "low"), 3, _linked(percent, FULL), "a long, b long, sure boolean"), "more-links")
        if not more.isEmpty():
            unsure = more.where("NOT sure").select("a", "b").distinct()
            found = components(links.union(more.where("sure").select("a", "b")).union(_confirmed(unsure, sets, percent)))

        linked = found.join(classes.select("node", "hi", "lo", "id"), "node")
        named = linked.groupBy("component").agg(F.min("id").alias("least"))
        known = linked.join(named, "component").select("hi", "lo", "least")
        copied = classes.where("copies > 1").join(found, "node", "left_anti").select("hi", "lo", F.col("id").alias("least"))
        known = keep(bounded(known.union(copied), "known"))
    out = rows.select("id", "n", "hi", "lo").join(known, ["hi", "lo"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("least", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: that with the least id."""
    ids = groups(docs, id_col, text_col, width, percent).groupBy(F.col(id_col).alias("__tm_gone")).agg(F.max("kept").alias("kept"))
    gone = bounded(ids.where("NOT kept").select("__tm_gone"), "gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["__tm_gone"], "left_anti")
