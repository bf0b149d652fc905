"""Structured Streaming: batches of uploads, progress of runs, liveness, and windows over events."""
