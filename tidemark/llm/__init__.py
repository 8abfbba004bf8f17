"""Operators of a training-data pipeline, on Spark DataFrames. Nothing else imports this package."""
