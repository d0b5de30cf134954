"""Catalogue-curation and listening-history analytics on Spark DataFrames."""
