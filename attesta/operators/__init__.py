"""Stages of the trust engine: functions from DataFrames to DataFrames. Run ids and dates are parameters."""
