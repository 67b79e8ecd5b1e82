"""Training-data operators: deduplication, filtering, mixing, sharding and encoding of text corpora.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
