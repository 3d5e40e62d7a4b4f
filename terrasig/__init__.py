"""Hazard-signal analytics expressed as Spark DataFrame operators and jobs."""
