"""paperlake: document analytics on Spark DataFrames."""
