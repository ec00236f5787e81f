"""clarion.streaming."""
