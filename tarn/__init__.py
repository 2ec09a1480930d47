"""Job-telemetry waste analytics on Spark DataFrames."""
