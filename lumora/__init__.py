"""Lumora: document grading analytics as Spark DataFrame transforms."""
