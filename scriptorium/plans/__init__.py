"""Scriptorium: plans."""
