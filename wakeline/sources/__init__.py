"""sources of the maritime analytics package."""
