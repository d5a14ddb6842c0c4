"""quarry: streaming."""
