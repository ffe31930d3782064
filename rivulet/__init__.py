"""Spark-first analytics over data-flow facts and training corpora."""
