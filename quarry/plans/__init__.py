"""Parameterised query plans over the driver tables."""
