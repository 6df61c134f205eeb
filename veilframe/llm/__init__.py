"""Operators of a training-data pipeline over tables of texts and vectors.

Each module holds one operator with its own interface; ``queries`` applies them to the given
tables. Nothing else in the library imports this package.
"""
