"""Schedule reconciliation, geometric evidence and check-in analytics on Spark DataFrames."""
