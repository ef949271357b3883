"""Operators: functions from DataFrame to DataFrame, and Columns they are made of."""
