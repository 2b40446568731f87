"""Operators for preparing training data: tokenising, packing, filtering, de-duplicating, extracting."""
