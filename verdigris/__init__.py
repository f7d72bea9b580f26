"""Verdigris: curation and analytics of verified training records on Spark.

Every operator takes DataFrames and returns a DataFrame. Nothing runs until an
action asks for it, save where a docstring names a table that is written first.
"""
