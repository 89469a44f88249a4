"""Operators over DataFrames: batch jobs, windows, logs, versioned tables, change data, events, placement, causality."""
