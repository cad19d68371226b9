"""Operators for large training corpora: classifiers, sharding, near-duplicates, counting, packing, mixing."""
