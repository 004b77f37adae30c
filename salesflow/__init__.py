"""Multi-tenant daily sales forecasting on Spark DataFrames."""
