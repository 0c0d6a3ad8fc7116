"""strandloom: genomic-interval and omics-matrix analytics on Spark DataFrames."""
