"""Incremental runs of the keyed upsert."""
