"""Purchase-history analytics and training-data preparation on Spark DataFrames."""
