"""Structured Streaming: windowed counts with watermarks, keyed last state, capped logs."""
