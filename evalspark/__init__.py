"""Evaluation analytics on Spark."""
