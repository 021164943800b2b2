"""Training-data operators: cleaning, deduplication, scoring and encoding of text tables.

Nothing outside this subpackage imports it.
"""
