"""Training-data operators: deduplication, search, mixing, quality, tokenising, archives, language.

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
