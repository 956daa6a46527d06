"""Operators for training-data pipelines: one module each, their registered queries in ``queries``."""
