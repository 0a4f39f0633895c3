"""Batch code-intelligence and corpus preparation on Spark."""
