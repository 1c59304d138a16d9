"""Structured Streaming forms of the call-log and snapshot operators."""
