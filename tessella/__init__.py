"""Sparse analytics and learning as Spark DataFrame operators."""
