"""Training-data operators: deduplication, filtering, scanning, mixing, sharding and tokenizing.

Nothing outside this subpackage imports it.
"""
