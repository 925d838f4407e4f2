"""Spreadsheet packages as DataFrames, and operators over them."""
