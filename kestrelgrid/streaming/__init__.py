"""Structured Streaming counterparts: debounced change feeds and the usage log."""
