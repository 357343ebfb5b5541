"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the thin registered queries are in :mod:`.queries`.
"""
