"""quarry: plans."""
