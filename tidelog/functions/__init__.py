"""Op-log analytics on Spark DataFrames."""
