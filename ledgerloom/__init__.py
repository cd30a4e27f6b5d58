"""Ledgerloom: data-processing operators for billing records and texts on PySpark."""

__version__ = "0.1.0"
