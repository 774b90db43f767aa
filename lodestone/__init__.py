"""Large-scale data mining on Spark DataFrames."""
