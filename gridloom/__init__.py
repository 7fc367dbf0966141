"""Spreadsheet formulas as a query language on Spark."""
