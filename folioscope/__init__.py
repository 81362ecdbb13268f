"""A document-collection analytics engine on Spark DataFrames."""
