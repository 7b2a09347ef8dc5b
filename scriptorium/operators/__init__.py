"""Scriptorium: operators."""
