"""Spark-first analytics over time-varying point and splat tables."""
