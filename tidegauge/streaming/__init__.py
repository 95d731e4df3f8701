"""Streaming jobs, their sinks and their progress records."""
