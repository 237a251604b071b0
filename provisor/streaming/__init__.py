"""Structured Streaming jobs with their batch twins."""
