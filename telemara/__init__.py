"""Incident-telemetry analytics as Spark jobs."""
