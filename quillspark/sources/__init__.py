"""Readers of feeds, pages and snapshots."""
