"""Operators that a training-data pipeline needs, each a set of Spark jobs.

Nothing else in the library imports this subpackage.
"""
