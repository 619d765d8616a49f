"""A training-data pipeline over `documents`: each stage reads what its predecessor kept, written as Parquet.

Language ID drops texts without a letter and those no language explains; line dedup takes out lines that a tenth of a
source's distinct texts share; near-dedup keeps one document of each group; decontamination drops documents that contain a
benchmark item; mixing gives each remaining document a rate.

Defined results: null and empty texts go in the first stage; repeated rows stay until near-dedup, which drops an id only if no
row of it is kept; rows without an id stay; null sources are one source; extra columns pass through, but for n_tokens,
posterior and rate, which the last stage writes; n_chars follows the cleaned text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontam, langid, line_dedup, mixing, near_dup
from tidemark.llm.common import cut, table
from tidemark.llm.queries import MIX_TARGETS, domains

#: A document stays if the mean probability of its language is at least this.
MIN_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = langid.fit(docs, ~langid.held_out("doc_id") & F.col("doc_id").isNotNull(), "text", "lang", "doc_id")
    found = langid.predict(docs, network, lang_name="__tm_lang", score_name="__tm_score")
    return found.where((F.col("__tm_lang") != langid.UNKNOWN) & (F.col("__tm_score") >= MIN_SCORE)).select(*docs.columns)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs, distinct=True).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, domains(spark, sf_dir), MIX_TARGETS, keep=docs.columns)


STAGES = [("language ID", language_id), ("line dedup", drop_site_lines), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID, signatures and mixing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
