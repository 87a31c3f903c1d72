"""Incremental relational dataflow on Spark: weighted tables, a small circuit language, snapshots and delta replay."""
