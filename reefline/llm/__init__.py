"""Operators of a training-data pipeline, with their queries. Nothing else in the package imports this one."""
