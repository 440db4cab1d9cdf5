"""Call-graph and dependency analytics on Spark DataFrames."""
