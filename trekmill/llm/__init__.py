"""Training-data operators: language id, mixing, dedup, extraction, packing, token files, search.

Nothing else in the library imports this subpackage.
"""
