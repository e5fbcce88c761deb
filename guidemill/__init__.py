"""Guidance-corpus analytics on PySpark DataFrames."""
