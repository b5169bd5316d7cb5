"""Operators for preparing training data: quality, mixing, near copies, packing and the like."""
