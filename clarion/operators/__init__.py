"""clarion.operators."""
