"""Threat-intelligence note analytics as Spark DataFrame jobs."""
