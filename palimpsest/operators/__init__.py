"""Operators on versions, files, trees, sequences, ranges and pattern instances."""
