"""Earth-observation change analytics and corpus tools on Spark DataFrames."""
