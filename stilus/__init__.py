"""stilus: authorship analytics and corpus preparation on Spark DataFrames."""
