"""Waymark: street-survey analytics on PySpark DataFrames."""
