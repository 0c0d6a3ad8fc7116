"""Streaming of strandloom."""
