"""Training-data operators: deduplication, search, cleaning, encoding and mixing.

Nothing else in the library imports this package.
"""
