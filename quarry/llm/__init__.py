"""Operators for large training-data pipelines.

Each module holds one operator with its own general interface; ``queries``
registers a thin digest query per operator. Nothing outside this package
imports it.
"""
