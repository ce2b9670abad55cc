"""Spark-first corpus analytics: reuse ranking of sources and tables."""
