"""Structured Streaming jobs over new files with checkpoints in the shared folder."""
