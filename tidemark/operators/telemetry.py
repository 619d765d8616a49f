"""Operation counters, slow operations, health, and text exposition of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalars import number, tier_name


def op_stats(log: DataFrame) -> DataFrame:
    """op, calls, errors, duration_nanos (of failed calls too) and the mean, from a log (op, duration_nanos, is_error)."""
    out = log.groupBy("op").agg(F.count(F.lit(1)).alias("calls"), F.count_if("is_error").alias("errors"), F.sum("duration_nanos").alias("duration_nanos"))
    return out.withColumn("avg_nanos", F.col("duration_nanos") / F.col("calls")).sort("op")


def slow_ops(log: DataFrame, threshold_nanos: int) -> DataFrame:
    return log.where(F.col("duration_nanos") >= threshold_nanos)


def health(status: DataFrame) -> DataFrame:
    """code and reason for rows (ready, has_mover, max_gap_s, uptime_s, last_tick_s, now_s); a gap of 0 turns the check off."""
    checked = F.col("has_mover") & (F.col("max_gap_s") > 0) & (F.col("uptime_s") > F.col("max_gap_s") + 2)
    reason = F.when(~F.col("ready"), "not ready").when(checked & (F.col("last_tick_s") == 0), "mover not ticking")
    reason = reason.when(checked & (F.col("now_s") - F.col("last_tick_s") > F.col("max_gap_s")), "mover tick too old").otherwise("ok")
    return status.withColumn("reason", reason).withColumn("code", F.when(F.col("reason") == "ok", 200).otherwise(503))


def metrics_text(samples: DataFrame, science: int = 6) -> DataFrame:
    """name and text: one HELP and one TYPE line for each name, then its samples (kind, name, help, labels, value) in label order.

    labels is text such as `tier="hot"`, empty for none. Values have an exponent from 10 to the power of `science`; either form
    is the same number to a reader of the text.
    """
    line = F.concat("name", F.when(F.col("labels") != "", F.concat(F.lit("{"), "labels", F.lit("}"))).otherwise(""), F.lit(" "), number(F.col("value"), science))
    each = samples.select("kind", "name", "help", F.struct("labels", line.alias("line")).alias("s"))
    groups = each.groupBy("name", "kind", "help").agg(F.sort_array(F.collect_list("s")).alias("s"))
    lines = F.array_join(F.transform("s", lambda s: s["line"]), "\n")
    head = F.concat(F.lit("# HELP "), "name", F.lit(" "), "help", F.lit("\n# TYPE "), "name", F.lit(" "), "kind", F.lit("\n"))
    return groups.select("name", F.concat(head, lines, F.lit("\n")).alias("text")).sort("name")


def op_samples(stats: DataFrame, prefix: str = "tidemark") -> DataFrame:
    """Samples of op_stats."""
    labels = F.concat(F.lit('op="'), "op", F.lit('"'))
    kinds = (("calls_total", "Calls by operation.", F.col("calls").cast("double")), ("errors_total", "Failed calls by operation.", F.col("errors").cast("double")), ("duration_seconds_total", "Total time by operation.", F.col("duration_nanos") / 1e9))
    three = F.array(*(F.struct(F.lit(f"{prefix}_op_{n}").alias("name"), F.lit(h).alias("help"), v.alias("value")) for n, h, v in kinds))
    return stats.select(labels.alias("labels"), F.explode(three).alias("m")).select(F.lit("counter").alias("kind"), "m.name", "m.help", "labels", "m.value")


def _one_row_samples(row: DataFrame, prefix: str, names: dict[str, tuple[str, str]]) -> DataFrame:
    """A sample without labels for each of names (column -> kind, help) of a table of one row."""
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(f"{prefix}_{c}").alias("name"), F.lit(text).alias("help"), F.lit("").alias("labels"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c, (kind, text) in names.items()))
    return row.select(F.explode(each).alias("m")).select("m.*")


def mover_samples(summary: DataFrame, prefix: str = "tidemark_mover") -> DataFrame:
    """Samples of maintenance.mover_summary."""
    counters = {"evicts": "Evict passes.", "gcs": "Collection passes.", "moves_ok": "Moves that worked.", "moves_failed": "Moves that failed.", "bytes_moved": "Bytes moved.", "move_nanos": "Time spent moving.", "gc_nanos": "Time spent collecting."}
    gauges = {"consecutive_errors": "Failing passes in a row.", "last_tick_s": "When the mover last ran.", "last_error_s": "When the mover last failed."}
    return _one_row_samples(summary, prefix, {k: ("counter", v) for k, v in counters.items()} | {k: ("gauge", v) for k, v in gauges.items()})


def segment_samples(usage: DataFrame, prefix: str = "tidemark") -> DataFrame:
    """Samples of maintenance.segment_usage: files and bytes by tier."""
    labels = F.concat(F.lit('tier="'), tier_name(F.col("tier")), F.lit('"'))
    both = F.array(*(F.struct(F.lit(f"{prefix}_segment_{c}").alias("name"), F.lit(h).alias("help"), F.col(v).cast("double").alias("value")) for c, h, v in (("count", "Segments by tier.", "segments"), ("bytes", "Bytes in segments by tier.", "bytes"))))
    return usage.select(labels.alias("labels"), F.explode(both).alias("m")).select(F.lit("gauge").alias("kind"), "m.name", "m.help", "labels", "m.value")
