"""Versioned byte-range metadata on Spark: overlay, compaction, usage, eviction, namespace and telemetry queries."""
