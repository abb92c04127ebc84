"""Whole plans made of operators, and lineage helpers."""
