"""Fits and scores over Structured Streaming."""
