"""Customer-journey analytics over append-only event logs, on Spark DataFrames."""
