"""Operators of a training-data pipeline over text corpora.

Nothing else in the library imports this subpackage. Each module has one
operator with a general interface; ``queries`` applies each operator to its
whole table.
"""
