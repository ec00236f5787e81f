"""clarion.sources."""
