"""Spark-first engine for bibliometric and corpus data processing."""
