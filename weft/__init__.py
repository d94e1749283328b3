"""Parallel-corpus analytics on Spark."""
