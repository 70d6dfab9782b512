"""Training-data operators: packing, archives, fingerprints, filters, joins, counts, sharding, encoding.

Nothing outside this subpackage imports it.
"""
