"""Operators of a large-scale training-data pipeline, each by one named method."""
