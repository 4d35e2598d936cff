"""tidemark: snapshot-versioned analytics on Spark DataFrames."""
