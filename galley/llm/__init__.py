"""Operators for large training corpora: filters, deduplication, tokenisation, scoring.

Nothing outside this subpackage imports it.  Every operator takes DataFrames, selects the columns it needs
at once (so further columns, whatever their names, cannot clash) and returns a DataFrame.
"""
