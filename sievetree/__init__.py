"""Learned cardinality estimation and corpus preparation on Spark."""
