"""Training-data operators: dedup, chat formatting, packing, scans, classifiers and filters.

Nothing else in the library imports this subpackage. The registered queries
are in :mod:`kindred.llm.queries`.
"""
