"""Operators: functions from DataFrames to DataFrames, one module per subject."""
