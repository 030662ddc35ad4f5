"""Operators of a training-data pipeline: formatting, rules, dedup, scans, token counts, packing.

Nothing else in the library imports this package.  Every operator takes a DataFrame, an id column
and a text column, and looks at no other column, so extra columns with any names do no harm.
"""
