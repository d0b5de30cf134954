"""Operators: functions from DataFrames to a DataFrame of results or proposed changes."""
