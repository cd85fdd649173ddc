"""Operators: functions from DataFrames to a DataFrame. None of them collects rows that grow with the data."""
