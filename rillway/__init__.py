"""rillway: snapshot, change-log and message synchronisation on Spark DataFrames."""
