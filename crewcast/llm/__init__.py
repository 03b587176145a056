"""Operators of a text corpus pipeline."""
