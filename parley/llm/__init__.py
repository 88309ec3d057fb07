"""Operators for preparing language-model training data, written as Spark jobs.

Nothing outside this subpackage imports it. ``entries`` holds the registered queries.
"""
