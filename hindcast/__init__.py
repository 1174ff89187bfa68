"""Analog retrieval, risk forecasts and forecast evaluation on Spark DataFrames."""
