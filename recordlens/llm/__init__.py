"""Operators for training text: archives, quality rules, packing, near copies, scores."""
