"""Structured Streaming: ingest with fan-out, stateful template decoding, delivery metrics."""
