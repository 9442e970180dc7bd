"""Hourly sensor analytics and short-term forecasting on Spark DataFrames."""
