"""lakeseek: hybrid retrieval and corpus analytics over source files, built on Spark DataFrames."""
