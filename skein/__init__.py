"""skein: analytics, retrieval and evaluation plans written as Spark DataFrames."""
