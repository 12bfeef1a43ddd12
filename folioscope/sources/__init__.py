"""Readers, writers and the mappings of providers' records to the canonical schema."""
