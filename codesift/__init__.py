"""Source-corpus auditing on Spark: files, lines, tokens, data flow and findings as DataFrames."""
