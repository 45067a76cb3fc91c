"""Trip analytics and recommendation engine on Spark DataFrames."""
