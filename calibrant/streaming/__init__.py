"""Structured Streaming forms of the calibration operators."""
