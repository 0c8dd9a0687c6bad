"""lexispark: a compressed text-index engine on Spark DataFrames."""
