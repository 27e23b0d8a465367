"""tickerloom: equity factor research and signal pools on Spark DataFrames."""
