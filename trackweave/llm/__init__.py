"""Operators of a training-data pipeline: each one a Spark job over a table of documents or vectors."""
