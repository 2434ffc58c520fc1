"""Operators on DataFrames of works: history, labels, selection, sampling, metrics and quality."""
