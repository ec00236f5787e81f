"""clarion.functions."""
