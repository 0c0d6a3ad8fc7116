"""Operators of strandloom."""
