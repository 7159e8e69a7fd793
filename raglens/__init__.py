"""Telemetry analytics for retrieval-augmented and LLM applications, on Spark."""
