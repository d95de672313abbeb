"""Training-data operators: everything here runs as Spark jobs and nothing else in the library imports it."""
