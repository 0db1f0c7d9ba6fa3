"""Operators for preparing training text, each built by one named method.

Nothing else in the library imports this package.  ``queries`` and ``oracles`` bind the operators to the
given tables.
"""
