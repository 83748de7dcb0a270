"""Training-data operators: scans, packing, encoding, archives, sharding and deduplication.

Nothing else in the library imports this subpackage.
"""
