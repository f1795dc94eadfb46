"""Operators: functions from DataFrames to DataFrames, generic over key, order and value columns."""
