"""Incremental import of manifests that arrive over time (Structured Streaming)."""
