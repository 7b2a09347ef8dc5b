"""Scriptorium: streaming."""
