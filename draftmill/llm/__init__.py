"""Operators for building language-model training data with Spark.

Nothing else in the package imports this subpackage.  Each module holds one
operator with a general interface; ``catalog`` holds the registered queries
and their SQL.
"""
