"""Operators for preparing training text and vectors: notes of runs, entity vectors, archives.

Nothing else in the library imports this subpackage.
"""
