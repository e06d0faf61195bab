"""keelson: adaptive key joins and relation layout on Spark DataFrames."""
