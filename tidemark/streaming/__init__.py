"""Structured Streaming: running flows, and stateful operators with constant state per key."""
