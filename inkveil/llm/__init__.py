"""Training-data operators: token counts, substring dedup, sharding, BPE, secrets,
nearest neighbours, WARC, n-gram Jaccard join, quality rules and packing.

Nothing else in the package imports this subpackage.
"""
