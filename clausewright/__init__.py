"""Clause retrieval and corpus preparation as Spark jobs."""
