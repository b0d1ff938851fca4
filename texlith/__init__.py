"""Spark-first originality scoring engine."""
