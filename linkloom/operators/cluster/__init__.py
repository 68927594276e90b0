"""Density clustering of a similarity, as a spanning tree on DataFrames and a pass over its branches."""
