"""Spark-first analytics over sparse graphs, signals in time and transit records."""
