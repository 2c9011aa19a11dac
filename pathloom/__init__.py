"""Process mining on Spark: event logs in, lazy DataFrames out."""
