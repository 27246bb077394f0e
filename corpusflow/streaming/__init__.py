"""Structured Streaming telemetry."""
