"""Hourly market-data and social-post analytics as Spark DataFrame jobs."""
