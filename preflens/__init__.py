"""Preference-optimisation analytics as plain Spark DataFrame jobs."""
