"""Functions of strandloom."""
