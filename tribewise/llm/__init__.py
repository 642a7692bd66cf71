"""Training-data operators: sharding, dedup, search, archives, token files, quality.

Nothing else in the library imports this subpackage.
"""
