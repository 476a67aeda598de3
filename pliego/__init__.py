"""Audit analytics for public-procurement records, written as Spark jobs."""
