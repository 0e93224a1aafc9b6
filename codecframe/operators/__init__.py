"""codecframe: operators."""
