"""Scriptorium: sources."""
