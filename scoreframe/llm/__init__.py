"""Operators a large-scale training-data pipeline needs, one module each."""
