"""quarry: operators."""
