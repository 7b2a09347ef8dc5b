"""Scriptorium: transcript, vocabulary and corpus analytics on PySpark DataFrames."""
