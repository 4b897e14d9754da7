"""Signature and distance analytics over sequence collections, built on PySpark."""

__version__ = "0.1.0"
