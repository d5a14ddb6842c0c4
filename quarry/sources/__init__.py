"""quarry: sources."""
