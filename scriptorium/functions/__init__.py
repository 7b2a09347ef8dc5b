"""Scriptorium: functions."""
