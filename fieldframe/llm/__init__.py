"""Operators of a training-data pipeline: text in, text or decisions out.

Nothing else in the library imports this subpackage.
"""
