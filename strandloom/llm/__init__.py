"""Training-data operators: tokenising, scoring, deduplicating, filtering and mixing documents.

Nothing outside this subpackage imports it.
"""
