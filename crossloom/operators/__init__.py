"""Tape operators: clean, combine, merge, match, settle, check, and time series."""
