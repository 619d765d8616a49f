"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item's MinHash signature is a sample of its own shingles (the least under each of n_perms hashes), so the share of the
signature that a document holds estimates how much of the item it contains, whatever the document's length. Items are
partitioned by size: those of fewer words than a shingle are shingled at their own width, and a document is looked up only
for items that its number of shingles can contain. A document that holds a quarter of an item's distinct signature shingles
is a candidate, so one shingle that many items share makes none; candidates are verified on the full sets, all items of a
document at once. At a threshold of 0.8 an item is overlooked with a chance of three in ten million. Native expressions only. The index has n_perms rows an item at most; it, and the candidate pairs, are broadcast only if
counted below BROADCAST_ROWS, and joined by a shuffle beyond.

Defined results: null and empty texts and items without words match nothing; several rows of one doc_id count as one
document that contains what any of them does (null is such an id too); repeated item_ids likewise; very long texts are
searched whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BROADCAST_ROWS, bounded, cut, word_array

WIDTH, THRESHOLD, N_PERMS = 5, 0.8, 16
#: A candidate holds at least one in so many of an item's signature shingles.
LEAST_OF = 4


def _shingle(words: str, at: str, width: int) -> Column:
    return F.expr(f"xxhash64({', '.join(f'{words}[{at} + {j}]' for j in range(width))})")


def _shingles(words: str, width: int) -> Column:
    inner = f"xxhash64({', '.join(f'{words}[i + {j}]' for j in range(width))})"
    return F.expr(f"CASE WHEN size({words}) >= {width} THEN array_distinct(transform(sequence(0, size({words}) - {width}), i -> {inner})) END")


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, n_perms: int = N_PERMS) -> DataFrame:
    """id_col, item_id, n_item_shingles, n_shared, containment: a row for each document and item it contains to threshold."""
    items = items.select(F.col(item_col).alias("item_id"), word_array(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0)
    items = items.withColumn("width", F.least(F.size("item_words"), F.lit(width)))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for w in sorted(r["width"] for r in items.select("width").distinct().collect()):
        found = _at_width(docs, items.where(F.col("width") == w), w, threshold, n_perms)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, n_item_shingles long, n_shared long, containment double")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item_shingles")).alias("m"))
    return best.select(F.col("doc_id").alias(id_col), "item_id", "m.n_item_shingles", "m.n_shared", "m.containment")


def _at_width(docs: DataFrame, items: DataFrame, width: int, threshold: float, n_perms: int) -> DataFrame:
    sets = bounded(items.select("item_id", _shingles("item_words", width).alias("item_set")), "item-sets", "item_set")
    least = (F.expr(f"array_min(transform(item_set, s -> struct(xxhash64(s, {k}) AS h, s AS s))).s") for k in range(n_perms))
    signature = sets.select("item_id", F.size("item_set").alias("m"), F.array_distinct(F.array(*least)).alias("signature"))
    need = F.ceil(F.size("signature") / LEAST_OF).cast("int")
    index = bounded(signature.select("item_id", "m", need.alias("need"), F.explode("signature").alias("s")), "index")
    n = F.size("words") - (width - 1)
    words = docs.select("doc_id", word_array(F.col("text")).alias("words"))
    probes = words.where(n > 0).select("doc_id", n.alias("n"), "words", F.posexplode("words").alias("at", "word")).where(F.col("at") < F.col("n"))
    probes = probes.select("doc_id", "n", _shingle("words", "at", width).alias("s"))
    hits = probes.join(index, "s").where(F.col("n") >= threshold * F.col("m")).select("doc_id", "item_id", "need", "s").distinct()
    candidates = cut(hits.groupBy("doc_id", "item_id", "need").agg(F.count(F.lit(1)).alias("hits")).where("hits >= need").select("doc_id", "item_id"), "candidates")
    few = candidates.count() <= BROADCAST_ROWS
    by_doc = candidates.groupBy("doc_id").agg(F.collect_list("item_id").alias("item_ids"))  # at most all items
    by_doc = F.broadcast(by_doc) if few else by_doc
    found = docs.alias("d").join(by_doc.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))).select("d.doc_id", "item_ids", word_array(F.col("text")).alias("words"))
    # A text is split and shingled once, below the rows of its items.
    pairs = found.select("doc_id", "item_ids", _shingles("words", width).alias("doc_set")).select("doc_id", "doc_set", F.explode("item_ids").alias("item_id"))
    pairs = pairs.join(sets, "item_id")
    shared = F.size(F.array_intersect("item_set", "doc_set")).cast("long")
    pairs = pairs.select("doc_id", "item_id", F.size("item_set").cast("long").alias("n_item_shingles"), shared.alias("n_shared"))
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles")).where(F.col("n_shared") >= threshold * F.col("n_item_shingles"))


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that contain an item."""
    leaks = contained(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("__tm_leak")).distinct()
    leaks = bounded(leaks, "leaks")
    return docs.join(leaks, docs[id_col].eqNullSafe(leaks["__tm_leak"]), "left_anti")
