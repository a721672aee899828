"""Schemas, feeds and snapshots."""
