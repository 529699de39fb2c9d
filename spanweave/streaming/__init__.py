"""Live frame feeds."""
