"""Spark-first DataOps analytics: profiling, statistics, SQL, registry reports, rules and metrics."""
