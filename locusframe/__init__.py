"""Point-localization analytics on Spark DataFrames."""
