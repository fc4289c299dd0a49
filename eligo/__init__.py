"""Batch jobs over clinical-trial records and their eligibility text, as Spark DataFrames."""
