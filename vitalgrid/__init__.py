"""Bulk survey-risk analytics as Spark DataFrame jobs."""
