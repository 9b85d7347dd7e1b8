"""Operators of a training-data pipeline: one module per operator.

Nothing else in the package imports this subpackage.
"""
