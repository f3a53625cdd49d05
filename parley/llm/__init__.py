"""Operators that a training-data pipeline needs; nothing outside this folder imports it."""
