"""Operators of a training-data pipeline: text quality, extraction, scoring, duplicates, mixing, sharding and tokens.

Nothing else in the package imports this subpackage. Each operator takes and returns DataFrames; the thin
``opN_<name>`` queries in ``queries.py`` apply them to the whole of their table.
"""
