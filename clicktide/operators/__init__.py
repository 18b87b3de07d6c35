"""Operators on event and aggregate frames."""
