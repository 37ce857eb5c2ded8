"""Structured Streaming operators on operational events."""
