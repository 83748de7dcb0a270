"""Retrieval and ranking operators: functions from DataFrames to DataFrames, with columns named by argument."""
