"""Text functions over columns."""
