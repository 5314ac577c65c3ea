"""Structured Streaming forms: session dedup, telemetry sink, running reports."""
