"""Operators for preparing large text corpora (training data) on Spark.

Nothing else in the library imports this subpackage.
"""
