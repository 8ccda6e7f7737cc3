"""Web-capture analytics on Spark DataFrames."""
