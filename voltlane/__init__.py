"""Energy telemetry analytics on Spark DataFrames."""
