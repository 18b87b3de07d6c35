"""Structured Streaming: the campaign stream, its sinks, replay and serving refresh."""
