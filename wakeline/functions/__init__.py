"""functions of the maritime analytics package."""
