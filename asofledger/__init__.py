"""Leakage-safe transaction analytics and training-data operators on Spark."""

from .sources.csv_source import CsvSchemaError, CsvSchemaReport, inspect_csv, read_permissive, read_strict

__all__ = ["CsvSchemaError", "CsvSchemaReport", "inspect_csv", "read_permissive", "read_strict"]
