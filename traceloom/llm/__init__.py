"""Training-data operators: sharding, scans, fingerprints, packing, near-duplicates and mixing.

Nothing outside this package imports it. Each operator takes DataFrames with any further
columns, reads only the columns it names and returns its own, so names never clash.
"""
