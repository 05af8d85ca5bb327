"""Training-data operators: extraction, dedup, packing, filtering, sharding.

Nothing outside this subpackage imports it.
"""
