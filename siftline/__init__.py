"""A Spark-first toolkit for observation logs, postings and training text."""
