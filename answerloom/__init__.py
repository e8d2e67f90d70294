"""Retrieval-based question answering over tables, written as Spark jobs."""
