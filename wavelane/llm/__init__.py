"""Operators for training-data pipelines over documents and pages.

Each module holds one operator with its own general interface; ``queries`` binds them to the
registered ``opN_`` names. Nothing else in the library imports this subpackage.
"""
