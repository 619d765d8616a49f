r"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the pages of the host; a line over max_ratio of them, on at
least min_pages pages, is boilerplate there and all its copies go. Native expressions only. Lines travel as two 64-bit
hashes and are counted before they are shuffled. What a host's pages have over the ratio is at most its mean number of
lines a page divided by the ratio, so a host's list stays small however many pages it has. The lists are broadcast if their
counted size is under BROADCAST_LINES, so that texts aren't shuffled; else they are joined by host, and Spark splits a hot one.

Defined results: a null text stays null and counts as a page without lines; null hosts are one host; blank lines are never
boilerplate; a page of boilerplate alone keeps its row with an empty text; repeated rows count as pages of their own unless
distinct is set: then equal texts of a host are one page, so that copies of a document don't make its lines boilerplate.
Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import add, cut, own

MAX_RATIO, MIN_PAGES, BROADCAST_LINES = 0.1, 3, 500_000


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit("line")).alias("b"))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """__tm_host and __tm_drop, an array of line keys: a row for each host that has any."""
    base = pages.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    line = F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("line")
    if distinct:
        # Only hashes are shuffled: a line counts once for each text that has it.
        base = base.select("host", _key(F.col("text")).alias("page"), "text")
        totals = base.groupBy("host", "page").agg(F.count(F.lit(1)))
        lines = base.select("host", "page", line).where(F.trim("line") != "").select("host", "page", _key(F.col("line")).alias("key"))
        lines = lines.groupBy("host", "page", "key").agg(F.count(F.lit(1)))
    else:
        totals = base
        lines = base.select("host", line).where(F.trim("line") != "").select("host", _key(F.col("line")).alias("key"))
    totals = totals.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    kept = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).where(F.col("n") > F.lit(max_ratio) * F.col("pages"))
    return kept.groupBy(counts["host"].alias("__tm_host")).agg(F.collect_set("key").alias("__tm_drop"))


def drop_lines(pages: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: bool = False, distinct: bool = False) -> DataFrame:
    """pages with the boilerplate lines of their host taken out of text_col; with counts, also n_lines and n_dropped."""
    known = cut(boilerplate(pages, host_col, text_col, max_ratio, min_pages, distinct), "boilerplate")
    lines, hosts = known.agg(F.sum(F.size("__tm_drop")), F.count(F.lit(1))).first()
    if (lines or 0) + hosts <= BROADCAST_LINES:
        known = F.broadcast(known)
    joined = pages.join(known, pages[host_col].eqNullSafe(known["__tm_host"]), "left")
    joined = add(joined, lines=F.split(F.col(text_col), "\n"))
    stays = F.filter("__tm_lines", lambda x: F.col("__tm_drop").isNull() | (F.trim(x) == "") | ~F.array_contains(F.col("__tm_drop"), _key(x)))
    joined = add(joined, kept=stays)
    out = {c: F.col(c) for c in own(pages)} | {text_col: F.array_join("__tm_kept", "\n")}
    more = [F.coalesce(F.size("__tm_lines"), F.lit(0)).cast("long").alias("n_lines"), (F.coalesce(F.size("__tm_lines"), F.lit(0)) - F.coalesce(F.size("__tm_kept"), F.lit(0))).cast("long").alias("n_dropped")]
    return joined.select(*(v.alias(k) for k, v in out.items()), *more * counts)
