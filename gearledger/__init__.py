"""Catalogue analytics for product components, written as Spark DataFrame jobs."""
