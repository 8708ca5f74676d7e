"""keepsake: governed-memory analytics on Spark DataFrames."""
