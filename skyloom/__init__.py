"""Spark-first analytics for recorded flight missions."""
