"""Trace analytics on Spark: run selection, parsing, per-register intelligence and features."""

__version__ = "0.1.0"
