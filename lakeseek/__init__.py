"""Retrieval and document analytics as Spark jobs."""
