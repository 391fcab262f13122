"""strandex: frequent substrings and utility queries over text, on Spark DataFrames."""
