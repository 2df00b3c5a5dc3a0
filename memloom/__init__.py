"""Text-memory analytics on Spark: functions from DataFrames to DataFrames."""
