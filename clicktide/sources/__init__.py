"""Where events and aggregates come from."""
