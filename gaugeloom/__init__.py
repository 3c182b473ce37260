"""Gaugeloom: spatio-temporal sensor analytics on Spark DataFrames."""
