"""Document structuring on Spark: sources, page operators, text functions, plans."""
