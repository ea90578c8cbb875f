"""Operators for preparing language-model training data, on Spark.

Nothing outside this subpackage imports it.  ``queries`` in the module of that
name registers one query for each operator.
"""
