"""Column functions over text, metadata and chunks."""
