"""termloom: text retrieval, corpus statistics and link analysis on Spark DataFrames."""
