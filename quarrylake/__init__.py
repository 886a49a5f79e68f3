"""Knowledge-bundle analytics on Spark DataFrames."""
