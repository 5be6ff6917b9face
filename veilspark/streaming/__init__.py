"""Fitted policies on Structured Streaming."""
