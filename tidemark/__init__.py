"""Migration reconciliation and assessment on Spark: DataFrames in, DataFrames out."""
