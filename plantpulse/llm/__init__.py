"""Operators for preparing large text corpora (language, quality, duplicates, tokens, packing).

Nothing else in the library imports this subpackage.
"""
