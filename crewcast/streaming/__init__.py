"""Incremental forms of two batch aggregates."""
