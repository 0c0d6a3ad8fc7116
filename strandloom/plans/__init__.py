"""Plans of strandloom."""
