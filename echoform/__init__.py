"""Echoform: exploring collections of time series by similarity, on Spark DataFrames."""
