"""Structured Streaming forms of the feature and detection operators."""
