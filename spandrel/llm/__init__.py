"""Operators for preparing training text.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames, reads only the columns it names (so extra or clashing columns in
its input never matter) and documents what it does with nulls, empty and very
long texts, ties, repeated rows and empty tables.
"""
