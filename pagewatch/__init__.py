"""Web-page change analytics on Spark DataFrames."""
