"""Training-data operators: scoring, tokenising, packing, near-duplicate and media work on document tables.

Nothing outside this subpackage imports it.
"""
