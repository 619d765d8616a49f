"""The namespace: nodes and directory entries as tables, lookups as joins, and edits as pure table transforms.

An edit takes a table of requests and returns a status (an errno, 0 if it applies) for each, with the tables after the ones
that apply. Requests of one batch see the tables as they were before it; of several that claim one name, the first applies. A
rename that depends on what an earlier one of its batch does gets EAGAIN and is to be asked again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalars import is_dir, is_symlink, valid_name
from tidemark.plans.ordered import row_numbers
from tidemark.schemas import EAGAIN, ERRNO, MAX_CLIMB, MODE_DIR, MODE_REGULAR, MODE_SYMLINK, PERM_MASK, ROOT_INODE, TYPE_MASK
from tidemark.session import settle


def lookup(requests: DataFrame, dirents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(parent, name) -> status and child: EINVAL for a bad name, ENOENT for none, EIO for an entry without a node."""
    found = requests.join(dirents, ["parent", "name"], "left").join(nodes.select(F.col("inode").alias("child"), F.lit(True).alias("there")), "child", "left")
    status = F.when(~valid_name(F.col("name")), ERRNO["EINVAL"]).when(F.col("child").isNull(), ERRNO["ENOENT"]).when(F.col("there").isNull(), ERRNO["EIO"]).otherwise(0)
    return found.select("parent", "name", status.alias("status"), F.when(status == 0, F.col("child")).alias("child"))


def walk_paths(paths: DataFrame, dirents: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, parts -> inode and status: one join per component; ENOTDIR on a file midway, ENOENT on a miss, EIO on
    an entry without a node midway.

    Symbolic links aren't followed. Finished paths leave the loop, so each level handles the deeper ones alone.
    """
    at = paths.select("path", "parts", F.lit(ROOT_INODE).cast("long").alias("inode"))
    kinds = nodes.select(F.col("inode").alias("n_inode"), "mode")
    out, depth = None, 0
    while True:
        done = at.where(F.size("parts") <= depth).select("path", "inode", F.lit(0).alias("status"))
        out = done if out is None else out.unionByName(done)
        left = at.where(F.size("parts") > depth)
        if left.isEmpty():
            return out
        left = left.join(kinds, F.col("inode") == F.col("n_inode"), "left").withColumn("part", F.col("parts")[depth])
        lost = left.where("mode IS NULL")
        out = out.unionByName(lost.select("path", F.lit(None).cast("long").alias("inode"), F.lit(ERRNO["EIO"]).alias("status")))
        files = left.where(~is_dir(F.col("mode")))
        out = out.unionByName(files.select("path", F.lit(None).cast("long").alias("inode"), F.lit(ERRNO["ENOTDIR"]).alias("status")))
        d = dirents.select(F.col("parent").alias("inode"), F.col("name").alias("part"), "child")
        stepped = settle(left.where(is_dir(F.col("mode"))).join(d, ["inode", "part"], "left").select("path", "parts", "child"), "walk")
        out = out.unionByName(stepped.where("child IS NULL").select("path", F.lit(None).cast("long").alias("inode"), F.lit(ERRNO["ENOENT"]).alias("status")))
        at, depth = stepped.where("child IS NOT NULL").select("path", "parts", F.col("child").alias("inode")), depth + 1


def path_tree(dirents: DataFrame) -> DataFrame:
    """inode, path and depth of everything below the root; a level at a time, each from the last one's table."""
    level = dirents.where(F.col("parent") == ROOT_INODE).select(F.col("child").alias("inode"), F.concat(F.lit("/"), "name").alias("path"), F.lit(1).alias("depth"))
    out, d = level, dirents.select(F.col("parent").alias("inode"), "name", "child")
    while True:
        level = settle(level.join(d, "inode").select(F.col("child").alias("inode"), F.concat("path", F.lit("/"), "name").alias("path"), (F.col("depth") + 1).alias("depth")), "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def readdir(dirents: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries with their nodes, in byte order of names within each directory; entries without a node are left out."""
    return dirents.join(nodes, F.col("child") == F.col("inode")).select("parent", "name", "inode", "mode", "size").sort("parent", "name")


def find_parent(dirents: DataFrame) -> DataFrame:
    """For each inode, the parent of its first entry in key order."""
    return dirents.groupBy(F.col("child").alias("inode")).agg(F.min("parent").alias("parent"))


def ancestors(inodes: DataFrame, dirents: DataFrame, max_steps: int = MAX_CLIMB) -> DataFrame:
    """inode, ancestor, steps: every directory above each inode, up to the root."""
    parents = settle(find_parent(dirents), "parents")
    at = inodes.select("inode", F.col("inode").alias("at"))
    out = None
    for step in range(1, max_steps + 1):
        p = parents.select(F.col("inode").alias("at"), F.col("parent").alias("up"))
        at = settle(at.where(F.col("at") != ROOT_INODE).join(p, "at").select("inode", F.col("up").alias("at")), "climb")
        if at.isEmpty():
            break
        rows = at.select("inode", F.col("at").alias("ancestor"), F.lit(step).alias("steps"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else inodes.select("inode", F.lit(None).cast("long").alias("ancestor"), F.lit(0).alias("steps")).limit(0)


def is_descendant(pairs: DataFrame, dirents: DataFrame, max_steps: int = MAX_CLIMB) -> DataFrame:
    """candidate, root -> below: whether root lies above candidate within max_steps; an inode is below itself."""
    up = ancestors(pairs.select(F.col("candidate").alias("inode")).distinct(), dirents, max_steps)
    hit = up.select(F.col("inode").alias("candidate"), F.col("ancestor").alias("root"), F.lit(True).alias("hit")).distinct()
    return pairs.join(hit, ["candidate", "root"], "left").select("candidate", "root", (F.coalesce("hit", F.lit(False)) | (F.col("candidate") == F.col("root"))).alias("below"))


def empty_dirs(dirents: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.where(is_dir(F.col("mode"))).select("inode").join(dirents.select(F.col("parent").alias("inode")).distinct(), "inode", "left_anti")


def link_counts(dirents: DataFrame, nodes: DataFrame) -> DataFrame:
    """nlink as the entries say: 2 and one for each child directory, or the number of names of a file."""
    kinds = nodes.select(F.col("inode").alias("child"), is_dir(F.col("mode")).alias("d"))
    entries = dirents.join(kinds, "child")
    subdirs = entries.where("d").groupBy(F.col("parent").alias("inode")).agg(F.count(F.lit(1)).alias("subdirs"))
    names = entries.groupBy(F.col("child").alias("inode")).agg(F.count(F.lit(1)).alias("names"))
    joined = nodes.join(subdirs, "inode", "left").join(names, "inode", "left")
    n = F.when(is_dir(F.col("mode")), 2 + F.coalesce("subdirs", F.lit(0))).otherwise(F.coalesce("names", F.lit(0)))
    return joined.select("inode", n.cast("long").alias("nlink"))


def stat(nodes: DataFrame, live: DataFrame) -> DataFrame:
    """Nodes under unflushed writes (inode, live_size, live_mtime_ns): size and times only ever rise; ctime follows mtime."""
    joined = nodes.join(live, "inode", "left")
    newer = F.col("live_mtime_ns") > F.col("mtime_ns")
    changed = {"size": F.greatest("size", F.coalesce("live_size", "size")), "mtime_ns": F.greatest("mtime_ns", F.coalesce("live_mtime_ns", "mtime_ns")), "ctime_ns": F.when(newer, F.greatest("ctime_ns", "live_mtime_ns")).otherwise(F.col("ctime_ns"))}
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in nodes.columns))


def attributes(nodes: DataFrame) -> DataFrame:
    """What a caller of getattr sees, with the stable id (type bits, inode, generation 1)."""
    out: dict[str, Column] = {"inode": F.col("inode"), "mode": F.col("mode"), "size": F.col("size"), "uid": F.col("uid"), "gid": F.col("gid")}
    for t in ("mtime", "ctime", "atime"):
        out |= {t: F.expr(f"{t}_ns div 1000000000"), f"{t}_nsec": F.expr(f"{t}_ns % 1000000000")}
    out["nlink"] = F.when(is_dir(F.col("mode")), 2).when(F.col("nlink") > 0, F.col("nlink")).otherwise(1).cast("long")
    out |= {"blksize": F.lit(4096), "blocks": F.expr("(size + 511) div 512"), "stable_mode": F.col("mode").bitwiseAND(F.lit(TYPE_MASK)), "generation": F.lit(1)}
    return nodes.select(*(c.alias(k) for k, c in out.items()))


def setattr_(nodes: DataFrame, updates: DataFrame, now_ns: Column) -> DataFrame:
    """Nodes after updates (inode and nullable mode, uid, gid, size, mtime_ns, atime_ns): null leaves alone, mode changes
    permission bits only, ctime becomes now. Shrinking sizes also cut fragments: see maintenance.truncate."""
    names = ["mode", "uid", "gid", "size", "mtime_ns", "atime_ns"]
    u = updates.select("inode", F.lit(True).alias("u"), *(F.col(c).alias(f"u_{c}") for c in names))
    joined = nodes.join(u, "inode", "left")
    changed = {c: F.coalesce(f"u_{c}", c) for c in names[1:]}
    perms = F.col("mode").bitwiseAND(F.lit(~PERM_MASK)).bitwiseOR(F.col("u_mode").bitwiseAND(F.lit(PERM_MASK)))
    changed |= {"mode": F.coalesce(perms, F.col("mode")), "ctime_ns": F.when(F.col("u"), now_ns).otherwise(F.col("ctime_ns"))}
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in nodes.columns))


def open_inodes(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """inode -> status; flags don't matter."""
    there = nodes.select("inode", F.lit(True).alias("there"))
    return requests.join(there, "inode", "left").select("inode", F.when(F.col("there"), 0).otherwise(ERRNO["ENOENT"]).alias("status"))


def readlink(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """inode -> status and target: EINVAL on what isn't a symbolic link."""
    joined = requests.join(nodes.select("inode", "mode", "symlink_target"), "inode", "left")
    status = F.when(F.col("mode").isNull(), ERRNO["ENOENT"]).when(~is_symlink(F.col("mode")), ERRNO["EINVAL"]).otherwise(0)
    return joined.select("inode", status.alias("status"), F.when(status == 0, F.col("symlink_target")).alias("target"))


def create(requests: DataFrame, dirents: DataFrame, nodes: DataFrame, first_inode: int, now_ns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create, mkdir and symlink. requests: request_id, kind (file, dir, symlink), parent, name, mode, uid, gid, target.

    Returns the requests with status and inode, and dirents and nodes after them.
    """
    kinds = nodes.select(F.col("inode").alias("parent"), F.col("mode").alias("p_mode"))
    known = dirents.select("parent", "name", F.lit(True).alias("taken"))
    joined = requests.join(kinds, "parent", "left").join(known, ["parent", "name"], "left")
    joined = joined.withColumn("turn", F.row_number().over(Window.partitionBy("parent", "name").orderBy("request_id")))
    status = F.when(~valid_name(F.col("name")), ERRNO["EINVAL"]).when(F.col("p_mode").isNull(), ERRNO["ENOENT"]).when(~is_dir(F.col("p_mode")), ERRNO["ENOTDIR"])
    status = status.when(F.col("taken").isNotNull() | (F.col("turn") > 1), ERRNO["EEXIST"]).otherwise(0)
    judged = settle(joined.withColumn("status", status), "judged")
    numbered = row_numbers(judged.where("status = 0"), ["request_id"], "inode", first_inode)
    bits = F.when(F.col("kind") == "dir", MODE_DIR).when(F.col("kind") == "symlink", MODE_SYMLINK).otherwise(MODE_REGULAR)
    perms = F.when(F.col("kind") == "symlink", F.lit(0o777)).otherwise(F.col("mode").bitwiseAND(F.lit(PERM_MASK)))
    target = F.when(F.col("kind") == "symlink", F.col("target"))
    made = numbered.select(
        "inode", bits.bitwiseOR(perms).cast("int").alias("mode"), F.when(F.col("kind") == "dir", 2).otherwise(1).cast("long").alias("nlink"), "uid", "gid",
        F.coalesce(F.octet_length(target), F.lit(0)).cast("long").alias("size"), *(F.lit(now_ns).cast("long").alias(f"{t}time_ns") for t in "mca"), target.alias("symlink_target"),
    )
    more = numbered.where("kind = 'dir'").groupBy(F.col("parent").alias("inode")).agg(F.count(F.lit(1)).alias("more"))
    old = nodes.join(more, "inode", "left")
    changed = {"nlink": F.col("nlink") + F.coalesce("more", F.lit(0)), "ctime_ns": F.when(F.col("more") > 0, F.lit(now_ns)).otherwise(F.col("ctime_ns"))}
    after = old.select(*(changed.get(c, F.col(c)).alias(c) for c in nodes.columns)).unionByName(made.select(*nodes.columns))
    results = judged.select("request_id", "status").join(numbered.select("request_id", "inode"), "request_id", "left")
    return results, dirents.unionByName(numbered.select("parent", "name", F.col("inode").alias("child"))), after


def link(requests: DataFrame, dirents: DataFrame, nodes: DataFrame, now_ns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hard links. requests: request_id, inode, parent, name. EPERM on directories."""
    t = nodes.select("inode", F.col("mode").alias("t_mode"))
    p = nodes.select(F.col("inode").alias("parent"), F.col("mode").alias("p_mode"))
    joined = requests.join(t, "inode", "left").join(p, "parent", "left").join(dirents.select("parent", "name", F.lit(True).alias("taken")), ["parent", "name"], "left")
    joined = joined.withColumn("turn", F.row_number().over(Window.partitionBy("parent", "name").orderBy("request_id")))
    status = F.when(~valid_name(F.col("name")), ERRNO["EINVAL"]).when(F.col("t_mode").isNull(), ERRNO["ENOENT"]).when(is_dir(F.col("t_mode")), ERRNO["EPERM"])
    status = status.when(F.col("p_mode").isNull(), ERRNO["ENOENT"]).when(~is_dir(F.col("p_mode")), ERRNO["ENOTDIR"]).when(F.col("taken").isNotNull() | (F.col("turn") > 1), ERRNO["EEXIST"]).otherwise(0)
    judged = joined.withColumn("status", status)
    done = judged.where("status = 0")
    after = _renumbered(nodes, done.groupBy("inode").agg(F.count(F.lit(1)).alias("delta")), now_ns)
    return judged.select("request_id", "status"), dirents.unionByName(done.select("parent", "name", F.col("inode").alias("child"))), after


def _renumbered(nodes: DataFrame, deltas: DataFrame, now_ns: int) -> DataFrame:
    """nlink changed by deltas (inode, delta), ctime now where there is one."""
    joined = nodes.join(deltas, "inode", "left")
    changed = {"nlink": F.col("nlink") + F.coalesce("delta", F.lit(0)), "ctime_ns": F.when(F.col("delta").isNotNull(), F.lit(now_ns)).otherwise(F.col("ctime_ns"))}
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in nodes.columns))


def _named_entries(requests: DataFrame, dirents: DataFrame, nodes: DataFrame) -> tuple[DataFrame, Column]:
    """Requests for an entry (request_id, parent, name) with its child and mode, and what speaks against any of them."""
    joined = requests.join(dirents, ["parent", "name"], "left").join(nodes.select(F.col("inode").alias("child"), "mode"), "child", "left")
    joined = joined.withColumn("turn", F.row_number().over(Window.partitionBy("parent", "name").orderBy("request_id")))
    return joined, F.when(~valid_name(F.col("name")), ERRNO["EINVAL"]).when(F.col("child").isNull(), ERRNO["ENOENT"]).when(F.col("mode").isNull(), ERRNO["EIO"])


def unlink(requests: DataFrame, dirents: DataFrame, nodes: DataFrame, now_ns: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Unlink (request_id, parent, name): status, dirents, nodes, and the inodes whose last name went (their bytes are free)."""
    joined, status = _named_entries(requests, dirents, nodes)
    status = status.when(is_dir(F.col("mode")), ERRNO["EISDIR"]).when(F.col("turn") > 1, ERRNO["ENOENT"]).otherwise(0)
    judged = settle(joined.withColumn("status", status), "judged")
    done = judged.where("status = 0")
    left, gone = _dropped(nodes, done.select(F.col("child").alias("inode")), now_ns)
    return judged.select("request_id", "status"), dirents.join(done.select("parent", "name"), ["parent", "name"], "left_anti"), left, gone


def _dropped(nodes: DataFrame, names: DataFrame, now_ns: int) -> tuple[DataFrame, DataFrame]:
    """Nodes after each of names (inode, a row a name) has lost a link, and the files among them that have none left."""
    lost = settle(names.groupBy("inode").agg((-F.count(F.lit(1))).alias("delta")), "lost")
    after = _renumbered(nodes, lost, now_ns)
    gone = settle(after.join(lost.select("inode"), "inode", "left_semi").where((F.col("nlink") <= 0) & ~is_dir(F.col("mode"))).select("inode"), "freed")
    return after.join(gone, "inode", "left_anti"), gone


def rmdir(requests: DataFrame, dirents: DataFrame, nodes: DataFrame, now_ns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove empty directories (request_id, parent, name)."""
    joined, status = _named_entries(requests, dirents, nodes)
    full = dirents.select(F.col("parent").alias("child"), F.lit(True).alias("full")).distinct()
    status = status.when(~is_dir(F.col("mode")), ERRNO["ENOTDIR"]).when(F.col("full").isNotNull(), ERRNO["ENOTEMPTY"]).when(F.col("turn") > 1, ERRNO["ENOENT"]).otherwise(0)
    judged = settle(joined.join(full, "child", "left").withColumn("status", status), "judged")
    done = judged.where("status = 0")
    after = _renumbered(nodes, done.groupBy(F.col("parent").alias("inode")).agg((-F.count(F.lit(1))).alias("delta")), now_ns)
    return judged.select("request_id", "status"), dirents.join(done.select("parent", "name"), ["parent", "name"], "left_anti"), after.join(done.select(F.col("child").alias("inode")), "inode", "left_anti")


def _first_claims(moves: DataFrame, dirents: DataFrame) -> DataFrame:
    """moves (which nothing speaks against by itself) with the status that the others of the batch leave them.

    Each needs its two entries, its source and its target, to itself: the least request that claims an entry has it. A source
    that is taken is gone (ENOENT). A directory can't be overwritten while the batch moves something into it, nor can one go
    below a directory that an earlier request moves: those are to be asked again (EAGAIN), as are targets that are taken.
    """
    claims = moves.select("request_id", F.col("old_parent").alias("parent"), F.col("old_name").alias("name")).union(moves.select("request_id", "new_parent", "new_name"))
    first = settle(claims.groupBy("parent", "name").agg(F.min("request_id").alias("first")), "claims")
    old, new = (first.select(F.col("parent").alias(f"{x}_parent"), F.col("name").alias(f"{x}_name"), F.col("first").alias(f"{x}_first")) for x in ("old", "new"))
    into = moves.select(F.col("new_parent").alias("dst"), F.lit(True).alias("entered")).distinct()
    up = ancestors(moves.where("src_dir").select(F.col("new_parent").alias("inode")).distinct(), dirents).select("inode", "ancestor")
    up = up.union(moves.where("src_dir").select(F.col("new_parent").alias("inode"), F.col("new_parent").alias("ancestor"))).distinct()
    moved = moves.where("src_dir").groupBy(F.col("src").alias("ancestor")).agg(F.min("request_id").alias("above"))
    above = settle(up.join(moved, "ancestor").groupBy(F.col("inode").alias("new_parent")).agg(F.min("above").alias("above")), "above")
    joined = moves.join(old, ["old_parent", "old_name"]).join(new, ["new_parent", "new_name"]).join(into, "dst", "left").join(above, "new_parent", "left")
    same = moves.groupBy("old_parent", "old_name").agg(F.min("request_id").alias("first_of_source"))
    joined = joined.join(same, ["old_parent", "old_name"])
    status = F.when(F.col("first_of_source") < F.col("request_id"), ERRNO["ENOENT"])
    later = (F.col("old_first") < F.col("request_id")) | (F.col("new_first") < F.col("request_id")) | (F.col("dst_dir") & F.col("entered").isNotNull()) | (F.col("src_dir") & (F.col("above") < F.col("request_id")))
    return joined.withColumn("status", status.when(F.coalesce(later, F.lit(False)), EAGAIN).otherwise(0)).select(*moves.columns)


def rename(requests: DataFrame, dirents: DataFrame, nodes: DataFrame, now_ns: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Renames (request_id, old_parent, old_name, new_parent, new_name): status, and after those that apply dirents, nodes, and
    the overwritten inodes whose last name went (their bytes are free).

    Checks in order: names, source, target parent, cycles, then what stands at the target. A move onto itself is a success
    that changes nothing. What is overwritten loses a link, or its node if it is an empty directory; the parents of a
    directory that goes change their link counts and ctimes.
    """
    kinds = settle(nodes.select("inode", is_dir(F.col("mode")).alias("d")), "kinds")
    as_ = lambda prefix: kinds.select(F.col("inode").alias(prefix), F.col("d").alias(f"{prefix}_dir"))
    src = dirents.select(F.col("parent").alias("old_parent"), F.col("name").alias("old_name"), F.col("child").alias("src"))
    dst = dirents.select(F.col("parent").alias("new_parent"), F.col("name").alias("new_name"), F.col("child").alias("dst"))
    joined = requests.join(src, ["old_parent", "old_name"], "left").join(dst, ["new_parent", "new_name"], "left")
    joined = joined.join(as_("src"), "src", "left").join(as_("dst"), "dst", "left").join(as_("new_parent"), "new_parent", "left")
    full = dirents.select(F.col("parent").alias("dst"), F.lit(True).alias("dst_full")).distinct()
    joined = settle(joined.join(full, "dst", "left"), "renames")
    pairs = joined.where("src_dir").select(F.col("new_parent").alias("candidate"), F.col("src").alias("root")).distinct()
    below = is_descendant(pairs, dirents).where("below").select(F.col("candidate").alias("new_parent"), F.col("root").alias("src"), F.lit(True).alias("cycle"))
    joined = joined.join(below, ["new_parent", "src"], "left")
    e = ERRNO
    status = F.when(~valid_name(F.col("old_name")) | ~valid_name(F.col("new_name")), e["EINVAL"]).when(F.col("src").isNull(), e["ENOENT"]).when(F.col("src_dir").isNull(), e["EIO"])
    status = status.when(F.col("new_parent_dir").isNull(), e["ENOENT"]).when(~F.col("new_parent_dir"), e["ENOTDIR"]).when(F.col("src_dir") & F.col("cycle").isNotNull(), e["EINVAL"])
    status = status.when(F.col("dst") == F.col("src"), 0).when(F.col("dst").isNotNull() & F.col("dst_dir").isNull(), e["EIO"])
    status = status.when(F.col("src_dir") & ~F.col("dst_dir"), e["ENOTDIR"]).when(~F.col("src_dir") & F.col("dst_dir"), e["EISDIR"])
    status = status.when(F.col("dst_dir") & F.col("dst_full").isNotNull(), e["ENOTEMPTY"]).otherwise(0)
    judged = settle(joined.withColumn("status", status), "judged")
    moving = (F.col("status") == 0) & ~F.coalesce(F.col("dst") == F.col("src"), F.lit(False))
    claimed = settle(_first_claims(judged.where(moving), dirents), "claimed")
    moves = claimed.where("status = 0")

    left = dirents.join(moves.select(F.col("old_parent").alias("parent"), F.col("old_name").alias("name")), ["parent", "name"], "left_anti")
    left = left.join(moves.select(F.col("new_parent").alias("parent"), F.col("new_name").alias("name")), ["parent", "name"], "left_anti")
    moved = moves.select(F.col("new_parent").alias("parent"), F.col("new_name").alias("name"), F.col("src").alias("child"))

    after, gone = _dropped(nodes, moves.where("NOT dst_dir").select(F.col("dst").alias("inode")), now_ns)
    after = after.join(moves.where("dst_dir").select(F.col("dst").alias("inode")), "inode", "left_anti")
    away = moves.where("src_dir AND old_parent <> new_parent")
    deltas = away.select(F.col("old_parent").alias("inode"), F.lit(-1).alias("d")).union(away.select("new_parent", F.lit(1))).union(moves.where("dst_dir").select("new_parent", F.lit(-1)))
    after = _renumbered(after, deltas.groupBy("inode").agg(F.sum("d").alias("delta")), now_ns)
    return judged.where(~moving).select("request_id", "status").union(claimed.select("request_id", "status")), left.unionByName(moved), after, gone
