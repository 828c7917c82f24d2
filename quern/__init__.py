"""quern: graph-learning analytics on Spark DataFrames."""
