"""The operators applied to the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, html_text, knn, langid, license_scan, line_dedup, mixing, near_dup, toxicity, warc
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(table(spark, sf_dir, "documents"), width=2)


#: Shares of the token budget; the domains are those of `labels`.
MIX_TARGETS = {"good": 0.8, "poor": 0.15, "toxic": 0.05}


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and domain of the labelled documents."""
    labels = table(spark, sf_dir, "labels")
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), domains(spark, sf_dir), MIX_TARGETS)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).where("record_type <> 'quarantined'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "grade", (F.col("severity") >= 0.5).alias("toxic"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_exact_topk, op3_near_dup, op4_mixing, op5_line_dedup, op6_warc, op7_html_extraction, op8_toxicity, op9_language_id, op10_decontamination)
}

ORACLE = {
    "op2_exact_topk": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM vectors q JOIN vectors x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5""",
    "op6_warc": """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digests AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM payloads),
placed AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS response FROM digests)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN response IS NULL OR page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM placed""",
    "op5_line_dedup": """
WITH split AS (SELECT doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS pages FROM split GROUP BY source),
counts AS (SELECT source, line, count(*) AS n FROM (SELECT source, unnest(list_distinct(lines)) AS line FROM split) WHERE trim(line, ' ') <> '' GROUP BY source, line),
dropped AS (SELECT c.source, list(line) AS gone FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
            WHERE n >= 3 AND n > 0.1::DOUBLE * pages GROUP BY c.source),
kept AS (SELECT s.*, list_filter(lines, lambda x: gone IS NULL OR NOT list_contains(gone, x)) AS stay
         FROM split s LEFT JOIN dropped d ON s.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(lines) END::BIGINT AS n_lines,
       CASE WHEN text IS NULL THEN 0 ELSE len(lines) - len(stay) END::BIGINT AS n_dropped,
       CASE WHEN text IS NOT NULL THEN array_to_string(stay, chr(10)) END AS text
FROM kept""",
    "op10_decontamination": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_sets AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS width, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS m FROM item_sets GROUP BY item_id),
doc_sets AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS s
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM words, (SELECT DISTINCT width FROM item_sets) WHERE len(w) >= width))
SELECT doc_id, item_id, m AS n_item_shingles, count(*) AS n_shared, count(*)::DOUBLE / m AS containment
FROM doc_sets JOIN item_sets USING (width, s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, m HAVING count(*) >= 0.8::DOUBLE * m""",
}
