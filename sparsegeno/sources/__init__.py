"""Panels from reads, text files and hard calls; results to files."""
