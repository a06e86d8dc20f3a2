"""Announcement analytics expressed as Spark DataFrame and Structured Streaming jobs."""
