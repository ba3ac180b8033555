"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  ``queries`` holds the
thin contract queries; every other module holds one operator with its own
general interface.
"""
