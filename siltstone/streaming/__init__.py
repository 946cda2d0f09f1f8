"""siltstone.streaming."""
