"""Configuration, patterns, whole pipelines and the query catalogue."""
