"""Operators for building training data: vectors, counters, packing and text screening."""
