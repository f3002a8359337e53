"""Training-data operators: packing, scoring, extraction, search, dedup, mixing.

Nothing outside this subpackage imports it.
"""
