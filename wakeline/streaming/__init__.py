"""streaming of the maritime analytics package."""
