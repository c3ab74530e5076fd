"""Incremental build-graph analytics on Spark."""
