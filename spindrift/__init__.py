"""Native analytics and grounded retrieval on Spark DataFrames."""
