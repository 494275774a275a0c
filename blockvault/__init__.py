"""Analytics of content-addressed, deduplicated backup repositories on Spark DataFrames."""
